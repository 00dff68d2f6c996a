"""Retrieval: postings, BM25, exact cosine top-k, reciprocal-rank fusion, selection under caps and budgets, and evaluation.

Filters run before any top-k and ties are always broken. Greedy selections, whose next step depends on the last, run in pandas over a
question's candidates, which the channels' top-k bounds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.scalars import words

K1, B = 1.2, 0.75
#: Reciprocal-rank fusion: the constant, and a weight for each channel.
RRF, WEIGHTS = 60, {"symbol": 1.0, "path": 1.5, "fts": 1.0, "shadow": 0.55, "vector": 2.0}


def postings(units: DataFrame, key: str, text: str) -> DataFrame:
    """TXT-16: term, unit, frequency, unit length."""
    rows = units.select(F.col(key).alias("unit"), words(F.coalesce(text, F.lit(""))).alias("terms")).withColumn("n_terms", F.size("terms"))
    return rows.select("unit", "n_terms", F.explode("terms").alias("term")).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("n_terms").alias("n_terms"))


#: Questions (or query vectors) that are scored at once: a stated set against all rows, in blocks. A block's terms or vectors go to the tasks.
BLOCK = 1000


def _leading(where: np.ndarray, score: np.ndarray, unit: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Places of the `limit` best of each (where, group): largest score, then smallest unit."""
    order = np.lexsort([unit, -score, group, where])
    w, g = where[order], group[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])])
    start = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[nth < limit]


#: Scores that are worked out at once, and found rows that wait beside the kept ones before they are sorted: both bound what a worker holds.
SCORES, WAITING = 1 << 19, 1 << 18
#: Bytes of rows in one Arrow batch, about; tasks for each core where blocks read the same rows again.
BATCH_BYTES, TASKS = 4 << 20, 4


def _bounded(spark: SparkSession) -> None:
    """Rows go to Python in batches of bounded bytes from here on, where the session does not ask for smaller ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _best(rows: DataFrame, columns: list[str], matrix: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]], width: int, names: pa.Array, limit: int, question: str, kinds: dict[str, str], grouped: bool = False) -> DataFrame:
    """question, unit, group, score, matched: of each partition the best rows; the rest never leaves it. matrix: scores (rounded here) and matches
    of a batch's rows (rows x questions); no match, no row; None, all match. width: columns of the widest matrix.

    Slices of a batch are scored. Without groups, a question's last kept score keeps most of a slice out, so that few rows wait to be sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        kept: list[tuple[np.ndarray, ...]] = []
        least, held, waiting = np.full(len(names), -np.inf), 0, 0

        def shrunk() -> None:
            nonlocal held, waiting
            parts = [np.concatenate(c) for c in zip(*kept, strict=True)]
            at = _leading(parts[0], parts[3], parts[1], parts[2], limit)
            kept[:] = [tuple(c[at] for c in parts)]
            held, waiting = len(at), 0
            if not grouped:  # in order of question and score
                n = np.bincount(kept[0][0], minlength=len(names))
                least[n == limit] = kept[0][3][np.cumsum(n)[n == limit] - 1]

        size = max(1, SCORES // max(1, width))
        for whole in batches:
            for at in range(0, len(whole), size):
                batch = whole.slice(at, size)
                score, match = matrix(batch)
                found = ~(score < least - 1e-6)  # scores are rounded to six decimals below
                r, q = np.nonzero(found if match is None else found & (match > 0))
                if not len(r):
                    continue
                labels = pc.dictionary_encode(batch["group"])
                code = np.array([codes.setdefault(x, len(codes)) for x in labels.dictionary.to_pylist()])
                unit, group = batch["unit"].to_numpy(zero_copy_only=False)[r], code[labels.indices.to_numpy(zero_copy_only=False)][r]
                kept.append((q, unit, group, np.round(score[r, q], 6), np.ones(len(r), np.int64) if match is None else match[r, q].astype(np.int64)))
                waiting += len(r)
                if waiting > max(WAITING, held):
                    shrunk()
        if kept:
            shrunk()
            q, unit, group, score, match = kept[0]
            labels = pa.array(list(codes), pa.string())
            for lo in range(0, len(q), 10_000):
                part = slice(lo, lo + 10_000)
                yield pa.record_batch([names.take(pa.array(q[part])), pa.array(unit[part]), labels.take(pa.array(group[part])), pa.array(score[part]), pa.array(match[part])], [question, "unit", "group", "score", "matched"])

    _bounded(rows.sparkSession)
    return rows.select(*columns).mapInArrow(run, f"{question} {kinds['question']}, unit {kinds['unit']}, group string, score double, matched long")


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def bm25(units: DataFrame, questions: DataFrame, key: str, text: str, limit: int = 10, group: str | None = None) -> DataFrame:
    """AGG-34, SORT-03: question, unit, score, matched (distinct terms of the question that the unit holds), asked (those it has) and place
    of the best units of each question (question, text); with group, of each question and group.

    Terms of the questions are counted over all units first, then every unit is scored against a block of questions where it lies, as a product
    of matrices, and each partition keeps its best: no join makes a row for a question and a unit, however common a term is.
    """
    terms = questions.select("question", F.array_distinct(words("text")).alias("terms")).filter(F.size("terms") > 0)
    rows = units.select(F.col(key).alias("unit"), (F.lit("") if group is None else F.coalesce(F.col(group).cast("string"), F.lit(""))).alias("group"), words(F.coalesce(text, F.lit(""))).alias("terms"))
    total = rows.agg(F.count(F.lit(1)).alias("units"), F.avg(F.size("terms")).alias("mean")).first()
    out, blocks = None, -(-max(1, terms.count()) // BLOCK)
    for block in range(blocks):
        part = terms.filter(F.pmod(F.xxhash64("question"), F.lit(blocks)) == block)
        asked = part.select("question", F.explode("terms").alias("term"))
        df = rows.select(F.explode(F.array_distinct("terms")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        pairs = asked.join(df, "term", "left").fillna(0, ["df"]).toArrow()  # a block's questions and their words
        names = pc.unique(pairs["question"])
        vocabulary = pc.unique(pairs["term"])
        q, t = (pc.index_in(pairs[c], value_set=v).to_numpy(zero_copy_only=False) for c, v in (("question", names), ("term", vocabulary)))
        holds = np.zeros((len(vocabulary), len(names)), np.float64)
        holds[t, q] = 1
        n = np.zeros(len(vocabulary))
        n[t] = pairs["df"].to_numpy(zero_copy_only=False)
        idf = np.log(1 + (total["units"] - n + 0.5) / (n + 0.5))
        shared = units.sparkSession.sparkContext.broadcast((vocabulary, holds, idf, float(total["mean"] or 1)))

        def matrix(batch: pa.RecordBatch, shared=shared) -> tuple[np.ndarray, np.ndarray]:
            vocabulary, holds, idf, mean = shared.value
            length = pc.list_value_length(batch["terms"]).to_numpy(zero_copy_only=False)
            at = pc.index_in(batch["terms"].flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), length)[at >= 0]
            tf = np.bincount(row * len(vocabulary) + at[at >= 0], minlength=len(batch) * len(vocabulary)).reshape(len(batch), -1).astype(float) if len(vocabulary) else np.zeros((len(batch), 0))
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)[:, None])
            return weight @ holds, (tf > 0).astype(float) @ holds

        kinds = {"question": _kind(questions, "question"), "unit": _kind(units, key)}
        found = _best(rows, ["unit", "group", "terms"], matrix, max(holds.shape), names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names, limit, "question", kinds, group is not None)
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("question", *(["group"] if group else [])).orderBy(F.desc("score"), "unit"))
    return out.withColumn("place", place).filter(F.col("place") <= limit).join(terms.select("question", F.size("terms").alias("asked")), "question")


def cosine_topk(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """SORT-01, SORT-02, UDF-07: exact cosines (clipped, by six decimals), ties by id. vectors: id, v; queries: query, q, a stated set that is
    taken in blocks. A vector is normalised once and scored against a block where it lies; each partition keeps its best."""
    rows = vectors.select(F.col("id").alias("unit"), F.lit("").alias("group"), F.col("v").cast("array<double>").alias("v"))
    spark, blocks, out = vectors.sparkSession, -(-max(1, queries.count()) // BLOCK), None
    if blocks > 1:  # the more blocks, the fewer tasks of one: each gives its best, which are sorted together
        rows = rows.coalesce(-(-TASKS * spark.sparkContext.defaultParallelism // blocks))
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", F.col("q").cast("array<double>").alias("q")).toArrow()
        shared = spark.sparkContext.broadcast(_unit(part["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) if len(part) else np.zeros((0, 1))))

        def matrix(batch: pa.RecordBatch, shared=shared) -> tuple[np.ndarray, None]:
            v = _unit(batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
            return (v @ shared.value.T if len(shared.value) else np.zeros((len(batch), 0))), None

        names = part["query"].combine_chunks()
        found = _best(rows, ["unit", "group", "v"], matrix, len(names), names, limit, "query", {"question": _kind(queries, "query"), "unit": _kind(vectors, "id")})
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("unit")))
    return out.select("query", F.col("unit").alias("id"), "score", place.alias("place")).filter(F.col("place") <= limit)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fused(channels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """WIN-09: channels holds question, unit, channel, place; a unit counts once a channel, at its first place."""
    weight = F.coalesce(*[F.when(F.col("channel") == c, F.lit(w)) for c, w in weights.items()], F.lit(0.0))
    first = channels.groupBy("question", "unit", "channel").agg(F.min("place").alias("place"))
    return first.groupBy("question", "unit").agg(F.round(F.sum(weight / (RRF + F.col("place"))), 9).alias("score"))


def coverage(terms: Column, tokens: Column, stems: Column) -> Column:
    """SET-06, SCL-17: the mean over query terms of 1 (a token), 0.8 (a stem) or 0."""
    hit = F.transform(terms, lambda t: F.when(F.array_contains(tokens, t), 1.0).when(F.array_contains(stems, t), 0.8).otherwise(0.0))
    return F.try_divide(F.aggregate(hit, F.lit(0.0), lambda a, b: a + b), F.size(terms).cast("double"))


def capped(ranked: DataFrame, question: str, file: str, order: list[Column], cap: int = 3, limit: int = 10) -> DataFrame:
    """WIN-10: at most `cap` of a file, then at most `limit` of a question."""
    rows = ranked.withColumn("in_file", F.row_number().over(Window.partitionBy(question, file).orderBy(*order))).filter(F.col("in_file") <= cap)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(question).orderBy(*order))).filter(F.col("place") <= limit).drop("in_file")


def windowed(rows: list[dict], maximum: int, cap: int = 3, overlap: float = 0.8) -> list[dict]:
    """WIN-10, JOIN-20: of ranked rows at most `cap` of a file and `maximum` in all; a row that covers `overlap` of the shorter of itself and
    a chosen one of its file is left out. Rows without start_line and end_line overlap nothing."""
    chosen, of = [], defaultdict(list)
    for row in rows:
        old = of[row["file"]]
        if len(old) >= cap:
            continue
        size = lambda r: r["end_line"] - r["start_line"] + 1
        common = lambda r: max(0, min(row["end_line"], r["end_line"]) - max(row["start_line"], r["start_line"]) + 1)
        if "start_line" in row and any(common(r) >= overlap * min(size(row), size(r)) for r in old):
            continue
        chosen.append(row)
        old.append(row)
        if len(chosen) >= maximum:
            break
    return chosen


def _each(ranked: DataFrame, choose: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """choose, for the ranked rows (score, then unit) of each question; adds place. The channels' top-k bounds a question's rows."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "place") + ", place int"

    def one(g: pd.DataFrame) -> pd.DataFrame:
        rows = g.sort_values(["score", "unit"], ascending=[False, True]).to_dict("records")
        out = choose([{k: v for k, v in r.items() if k != "place"} for r in rows])
        return pd.DataFrame([r | {"place": i + 1} for i, r in enumerate(out)])

    return ranked.groupBy("question").applyInPandas(one, schema)


def diverse(ranked: DataFrame, slack: float = 0.005) -> DataFrame:
    """WIN-11: question, unit, file, score, optionally coverage, exact, start_line, end_line. After the window of each file, a repeat of a file
    yields to the best unseen file whose score is at least its own / (1 + slack x repeats) and which covers as much of the question; exact rows yield to none."""

    def choose(rows: list[dict]) -> list[dict]:
        left, seen, out = windowed(rows, len(rows)), {}, []
        while left:
            pick, again = left[0], seen.get(left[0]["file"], 0)
            if again and not pick.get("exact"):
                near = [r for r in left[1:] if r["score"] >= pick["score"] / (1 + slack * again)]
                pick = next((r for r in near if r["file"] not in seen and r.get("coverage", 0) >= pick.get("coverage", 0)), pick)
            left.remove(pick)
            seen[pick["file"]] = seen.get(pick["file"], 0) + 1
            out.append(pick)
        return out

    return _each(ranked, choose)


def rescued(ranked: DataFrame, first: int = 5) -> DataFrame:
    """WIN-12: question, unit, file, score, protected, lexical. Where the first window of a question lacks a protected row, the window is
    chosen with the protected rows in front; its lexical rows come first, then the other lexical ones, then the rest, each in their order."""

    def choose(rows: list[dict]) -> list[dict]:
        protected = [r for r in rows if r["protected"]]
        ids = {r["unit"] for r in protected}
        if ids <= {r["unit"] for r in windowed(rows, first)}:
            return rows
        window = {r["unit"] for r in windowed(protected + [r for r in rows if r["unit"] not in ids], first)}
        return sorted(rows, key=lambda r: 2 if not r["lexical"] else int(r["unit"] not in window))

    return _each(ranked, choose)


def budgeted(ranked: DataFrame, budget: int) -> DataFrame:
    """SORT-07, SORT-09: question, place, unit, tokens; in order of place what still fits is taken, smaller later ones too."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g, left, keep = g.sort_values("place"), budget, []
        for n in g["tokens"]:
            keep.append(n <= left)
            left -= n if keep[-1] else 0
        return g[keep]

    return ranked.groupBy("question").applyInPandas(one, ranked.schema)


def question_metrics(results: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """AGG-22: hit at 1, 3, 5, 10, reciprocal rank and recall within ten. results: question, unit, place; expected: question, unit."""
    top = results.filter("place <= 10")
    hits = top.join(expected, ["question", "unit"]).groupBy("question").agg(F.min("place").alias("first"), F.count_distinct("unit").alias("found"))
    wanted = expected.groupBy("question").agg(F.count_distinct("unit").alias("wanted"))
    out = questions.select("question").join(wanted, "question").join(hits, "question", "left")
    hit = [F.coalesce(F.col("first") <= k, F.lit(False)).alias(f"hit_{k}") for k in (1, 3, 5, 10)]
    return out.select("question", *hit, F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.coalesce("found", F.lit(0)) / F.col("wanted"), 6).alias("recall"))


def summary(metrics: DataFrame, latency: str | None = None) -> DataFrame:
    """AGG-24, AGG-25: macro means, and nearest-rank percentiles of a measure."""
    means = [F.round(F.avg(F.col(f"hit_{k}").cast("int")), 6).alias(f"hit_{k}") for k in (1, 3, 5, 10)]
    tail = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {latency})").alias(f"p{int(100 * p)}") for p in (0.5, 0.95)] if latency else []
    return metrics.agg(F.count(F.lit(1)).alias("questions"), *means, F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall"), *tail)


def summaries(metrics: DataFrame, *groups: str) -> DataFrame:
    """AGG-41, SNK-12: the same means for all questions and by each of some labels alone: group, label and the summary's columns, in one scan."""
    each = F.explode(F.array(F.struct(F.lit("all").alias("group"), F.lit("").alias("label")), *[F.struct(F.lit(g).alias("group"), F.col(g).cast("string").alias("label")) for g in groups]))
    means = [F.round(F.avg(F.col(f"hit_{k}").cast("int")), 6).alias(f"hit_{k}") for k in (1, 3, 5, 10)]
    rows = metrics.withColumn("g", each)
    return rows.groupBy("g.group", "g.label").agg(F.count(F.lit(1)).alias("questions"), *means, F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall"))


def evaluated(questions: DataFrame, expected: DataFrame, search: Callable[[DataFrame, int], DataFrame], *groups: str) -> DataFrame:
    """UDF-08: the summaries of any engine: search takes (questions, limit) and returns question, unit, place."""
    found = question_metrics(search(questions, 10), expected, questions)
    return summaries(found.join(questions.select("question", *groups), "question"), *groups)


def budget_metrics(results: DataFrame, expected: DataFrame, budget: int) -> DataFrame:
    """AGG-23: within the first 4 x budget characters in order of place: characters of expected units, of all, and the hit."""
    before = F.coalesce(F.sum("characters").over(Window.partitionBy("question").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = results.withColumn("before", before).withColumn("used", F.greatest(F.lit(0), F.least(F.col("characters"), F.lit(4 * budget) - F.col("before"))))
    rows = rows.filter("used > 0").join(expected.select("question", "unit").distinct().withColumn("right", F.lit(True)), ["question", "unit"], "left")
    right = F.sum(F.when(F.col("right"), F.col("used")).otherwise(0))
    return rows.groupBy("question").agg(F.sum("used").alias("used_characters"), right.alias("right_characters"), F.coalesce(F.max("right"), F.lit(False)).alias("hit"))


def embedded(texts: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """UDF-01: the offline embedding: hashed term counts, normalised. A provider with a model takes this function's place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for batch in batches:
            out = []
            for terms in batch["terms"]:
                v = [0.0] * dim
                for t in terms:
                    h = zlib.crc32(t.encode())
                    v[h % dim] += 1.0 if h & 1 << 31 else -1.0
                norm = sum(x * x for x in v) ** 0.5 or 1.0
                out.append([x / norm for x in v])
            yield pd.DataFrame({"id": batch["id"], "v": out})

    return texts.select(F.col(key).cast("string").alias("id"), words(F.coalesce(text, F.lit(""))).alias("terms")).mapInPandas(run, "id string, v array<float>")
