"""Suffix-array dedup: bytes covered by a 400-byte string that starts at two places or more, and documents that share a passage
of over 50 words with another.

Sorting the suffixes at every byte of 100 TB would write many times the input, so the array is sparse without losing a match:
- In each window of `length` bytes, the `gram`-byte string with the smallest hash (the leftmost of equals) is its anchor. Equal
  windows have their anchor at the same distance l, and an anchor serves a few hundred windows in a row.
- The windows of an anchor are dealt into classes by l, steps[0] distances to a class. All of them share the same inner
  length - steps[0] + 1 bytes: the suffix that is entered for the class, with its leading bytes and the inner and the outer
  (all windows together) strings' fingerprints as its tokens.
- Sampled splitters range-partition the suffixes by leading tokens, place last, so that even one frequent string is
  spread over buckets. Buckets sort locally by multikey quicksort and compare neighbours. Equal strings stand side by side in the
  whole order, so that only a bucket's first and last string can go on in another one: these, one row each, are compared across boundaries.
- An inner string that occurs once ends its class: none of its windows repeats. An outer one that occurs twice ends it too: all
  do. Between the two, which happens at the ends of matches only, the class is entered again with the finer steps, the last of
  which are the single windows, next to one class for each repeated outer string that has the same inner one. Strings are compared by 64-bit fingerprints next to their first eight bytes, at each level.

The same is done with words in the place of bytes (runs of anything but white space, A-Z in lower case), 51 to a window, where a window
counts once a document: `shared` marks documents that hold a passage of over 50 words which another document holds too.

Texts are shuffled once, and then those with a repeated inner string alone; joins with texts are merge joins at every size, so
that no list of documents is broadcast and a run over more data does not change its plan. Then each document's repeated starts are united.

Nulls, ties, empties: null text is empty; texts under LENGTH bytes keep all; repeated rows are documents of their own, so that they
remove one another; a null id is an id of its own; cuts fall between bytes, so what is kept may not be UTF-8; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import LOWER, SOLID, buffers, dropped, mixed, prefix_sums, slices, span_hashes, stored, text_or_empty, words_of


class Shape(NamedTuple):
    """What a window is: symbols in it, in an anchor, distances to a class from round to round; words or bytes."""

    length: int
    gram: int
    steps: tuple[int, ...]
    words: bool


BYTES, PASSAGE = Shape(400, 16, (128, 16, 1), False), Shape(51, 4, (32, 8, 1), True)
LENGTH = BYTES.length
#: Suffixes in a bucket, about.
BUCKET = 1_000_000
SUFFIX = "id long, key long, place long, t0 long, t1 long, t2 long"
#: place packs where a class's windows start: first << 20 | (anchor - first) << 10 | (last - first).


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` values: block-wise minima from the left and from the right."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def symbols(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' symbols (bytes, or hashes of words), n+1 counts up to each row, and prefix sums of the symbols."""
    if shape.words:
        data = LOWER[data]
        starts, ends, offsets = words_of(data, offsets, SOLID)
        data = span_hashes(prefix_sums(data), starts, ends)
    return data, offsets, prefix_sums(data)


def anchored(offsets: np.ndarray, sums: np.ndarray, step: int, shape: Shape) -> tuple[np.ndarray, ...]:
    """row, first, last window start and anchor of every class (places of symbols)."""
    size, length, gram = len(sums) - 1, shape.length, shape.gram
    n = size - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    at = np.arange(size - gram + 1)
    hashes = span_hashes(sums, at, at + gram)
    least = sliding_least((hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(size + 2, np.int32)  # windows lie within one row
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, offsets[long + 1] - length + 1, -1)
    valid = np.cumsum(valid[:n]) > 0
    code = anchor * 1024 + (anchor - np.arange(n)) // step
    new = np.ones(n, bool)
    new[1:] = (code[1:] != code[:-1]) | ~valid[:-1]
    new[offsets[long]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    ok = valid[first]
    first, last = first[ok], last[ok]
    # a run of valid windows may run into invalid ones
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first, np.minimum(last, offsets[row + 1] - length), anchor[first]


def tokens(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, row: np.ndarray, inner: np.ndarray, step: int, part: np.ndarray, salt: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """The suffixes' tokens: leading eight bytes (two words' fingerprint), inner and outer fingerprint. Classes at other distances from
    their anchor (part) hold other windows, even where two of them start at one place. An outer string beyond its row is like no other."""
    if shape.words:
        t0 = span_hashes(sums, inner, inner + 2).view(np.int64)
    else:
        lead = np.zeros((len(inner), 8), np.uint8)
        for k in range(8):
            lead[:, k] = data[inner + k]
        t0 = lead.view(">i8")[:, 0].astype(np.int64)
    t1 = span_hashes(sums, inner, inner + shape.length - step + 1) ^ mixed(part.astype(np.uint64) + np.uint64(1))
    start, end = inner - step + 1, inner + shape.length
    inside = (start >= offsets[row]) & (end <= offsets[row + 1])
    outer = span_hashes(sums, np.where(inside, start, 0), np.where(inside, end, 0))
    alone = mixed(salt.astype(np.uint64) ^ mixed(inner.astype(np.uint64) + np.uint64(1)))
    t2 = np.where(inside, outer, alone)
    return t0, t1.view(np.int64), t2.view(np.int64)


def once(row: np.ndarray, ts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Places of the first of equal tokens of each row."""
    key = row.astype(np.uint64)
    for t in ts:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + t.view(np.uint64))
    return np.sort(np.unique(key, return_index=True)[1])


def made(ids: pa.Array, keys: pa.Array, row: np.ndarray, place: np.ndarray, ts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    take = pa.array(row)
    return pa.record_batch([ids.take(take), keys.take(take), pa.array(place), *map(pa.array, ts)], [c.split()[0] for c in SUFFIX.split(", ")])


def coarse(texts: DataFrame, shape: Shape) -> DataFrame:
    """The suffixes of all classes of all texts."""
    step = shape.steps[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for i, j in slices(offsets, 1 << 20):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                part, at, sums = symbols(part, at, shape)
                row, first, last, anchor = anchored(at, sums, step, shape)
                if len(row):
                    salt = batch["key"].slice(i, j - i).to_numpy()[row]
                    of = (anchor - first) // step
                    ts = tokens(part, at, sums, row, anchor - of * step, step, of, salt, shape)
                    place = (first - at[row]) << 20 | (anchor - first) << 10 | (last - first)
                    if shape.words:
                        keep = once(row, ts)
                        row, place, ts = row[keep], place[keep], tuple(t[keep] for t in ts)
                    yield made(batch["id"].slice(i, j - i), batch["key"].slice(i, j - i), row, place, ts)

    return texts.select("id", "key", "text").mapInArrow(run, SUFFIX)


def finer(texts: DataFrame, step: int, shape: Shape) -> DataFrame:
    """The suffixes of classes (array column places) that are entered again with a finer step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for i in range(len(batch)):
                part, at = data[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i]
                classes = np.sort(batch["places"][i].values.to_numpy())
                first, anchor = classes >> 20, (classes >> 20) + (classes >> 10 & 1023)
                count = (classes & 1023) + 1
                anchor = np.repeat(anchor, count)
                start = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                part_of = (anchor - start) // step
                new = np.ones(len(start), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (part_of[1:] != part_of[:-1]) | (start[1:] != start[:-1] + 1)
                lo = np.flatnonzero(new)
                size = np.diff(np.append(lo, len(start)))
                anchor, start, inner = anchor[lo], start[lo], anchor[lo] - part_of[lo] * step
                row = np.zeros(len(lo), np.int64)
                part, at, sums = symbols(part, at, shape)
                salt = np.full(len(lo), batch["key"][i].as_py(), np.int64)
                ts, place = tokens(part, at, sums, row, inner, step, part_of[lo], salt, shape), start << 20 | (anchor - start) << 10 | (size - 1)
                if shape.words:
                    keep = once(row, ts)
                    row, place, ts = row[keep], place[keep], tuple(t[keep] for t in ts)
                yield made(batch["id"].slice(i, 1), batch["key"].slice(i, 1), row, place, ts)

    return texts.select("id", "key", "text", "places").mapInArrow(run, SUFFIX)


def multikey_order(keys: list[np.ndarray], small: int = 1 << 14) -> np.ndarray:
    """Order of rows by keys: three-way partitions around a pivot of one key, equal rows going on with the next key;
    short ranges are sorted outright."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if depth == len(keys) or hi - lo < 2:
            continue
        own = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = own[np.lexsort([k[own] for k in keys[depth:][::-1]])]
            continue
        x = keys[depth][own]
        pivot = np.sort(x[:: max(1, len(x) // 9)])[4]
        less, more = x < pivot, x > pivot
        parts = own[less], own[~(less | more)], own[more]
        order[lo:hi] = np.concatenate(parts)
        a, b = lo + len(parts[0]), hi - len(parts[2])
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def compared(suffixes: DataFrame) -> DataFrame:
    """id, key, place of classes whose inner string repeats; all_repeat: the outer one does; again: to be entered with finer
    steps, which are the classes whose outer string does not repeat and, for each repeated outer string that shares (or, at a
    bucket's edge, may share) an inner one with such a class, one class that stands for it."""
    n = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // BUCKET))
    schema = f"{SUFFIX}, kind int"  # outer repeats: 2, 3 (stands for it), 4 (and is at an edge); inner repeats: 1, 5 (outer at an edge); 0: neither, at an edge

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = [b for b in batches if len(b)]
        if not all_rows:
            return
        rows = pa.Table.from_batches(all_rows)
        keys = [rows[c].to_numpy() for c in ("t0", "t1", "t2")]
        order = multikey_order(keys)
        a, b, c = (k[order] for k in keys)
        differs = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        other = differs | np.concatenate([[True], c[1:] != c[:-1]])
        inner, outer = np.cumsum(differs) - 1, np.cumsum(other) - 1
        inner_n, outer_n = np.bincount(inner)[inner], np.bincount(outer)[outer]
        mixed_run = (np.bincount(inner, outer_n == 1) > 0)[inner] | (inner == 0) | (inner == inner[-1])
        kind = np.where(outer_n > 1, np.where(other & mixed_run, 3, 2), np.where(inner_n > 1, 1, -1)).astype(np.int32)
        edge = (outer == 0) | (outer == outer[-1])
        kind[edge] = np.where(outer_n > 1, np.where(other, 4, 2), np.where(inner_n > 1, 5, 0))[edge]
        keep = np.flatnonzero(kind >= 0)
        for at in range(0, len(keep), 100_000):
            now = keep[at : at + 100_000]
            part = rows.take(pa.array(order[now])).append_column("kind", pa.array(kind[now]))
            yield from part.combine_chunks().to_batches()

    out = suffixes.repartitionByRange(n, "t0", "t1", "t2", "id", "place").mapInArrow(bucket, schema)
    out = stored(out, "suffix-runs")
    edges = out.filter("kind IN (0, 4, 5)")  # two rows a bucket at most
    weight = F.sum(F.when(F.col("kind") == 4, 2).otherwise(1))
    outer = edges.groupBy("t0", "t1", "t2").agg(weight.alias("n"))
    inner = edges.groupBy("t0", "t1").agg(weight.alias("all"))
    across = edges.filter("kind <> 4").join(inner, ["t0", "t1"]).join(outer, ["t0", "t1", "t2"]).filter("all > 1 OR kind = 5")
    across = across.select("id", "key", "place", (F.col("n") > 1).alias("all_repeat"), F.lit(True).alias("again"))
    sure = out.filter("kind IN (1, 2, 3, 4)").select("id", "key", "place", (F.col("kind") >= 2).alias("all_repeat"), (F.col("kind") != 2).alias("again"))
    found = stored(sure.unionByName(across), "suffix-found")
    dropped(suffixes.sparkSession, out)
    return found


def identified(docs: DataFrame) -> DataFrame:
    """doc_id and text with id and key, which stand for a row (rows equal in both get the same result)."""
    text = text_or_empty()
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))).alias("id"), F.xxhash64("doc_id", text).alias("key"), text.alias("text"))


def repeated(docs: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Texts (id, key, text) with a repeated inner string, the places of classes all of whose windows repeat (id, key, place), and the
    stored tables that both are read from."""
    texts = identified(docs)
    entered = stored(coarse(texts, shape), "suffix-entered")
    found = [compared(entered)]
    dropped(docs.sparkSession, entered)
    some = found[0].select("id", "key").distinct()
    texts = stored(texts.drop("doc_id").join(some.hint("merge"), ["id", "key"], "left_semi"), "suffix-texts")
    for step in shape.steps[1:]:
        part = found[-1].filter("again").groupBy("id", "key").agg(F.collect_set("place").alias("places"))
        entered = stored(finer(texts.join(part.hint("merge"), ["id", "key"]), step, shape), "suffix-entered")
        found.append(compared(entered))
        dropped(docs.sparkSession, entered)
    places = found[0].filter("all_repeat").select("id", "key", "place")
    for f in found[1:]:
        places = places.unionByName(f.filter("all_repeat").select("id", "key", "place"))
    return texts, places, [texts, *found]


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """id, key, kept (the bytes that stay), n_removed, n_spans of the documents that lose bytes; the stored tables behind it."""
    texts, places, read = repeated(docs, BYTES)
    places = places.groupBy("id", "key").agg(F.collect_set("place").alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]]
                p = batch["places"][i].values.to_numpy()
                cover = np.zeros(len(text) + 1, np.int32)
                np.add.at(cover, p >> 20, 1)
                np.add.at(cover, (p >> 20) + (p & 1023) + LENGTH, -1)
                gone = np.cumsum(cover)[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                yield pa.record_batch([batch["id"].slice(i, 1), batch["key"].slice(i, 1), pa.array([text[~gone].tobytes()], pa.binary()), pa.array([int(gone.sum())], pa.int64()), pa.array([spans], pa.int64())], ["id", "key", "kept", "n_removed", "n_spans"])

    out = texts.join(places.hint("merge"), ["id", "key"]).select("id", "key", "text", "places")
    return out.mapInArrow(cut, "id long, key long, kept binary, n_removed long, n_spans long"), read


def sharing(docs: DataFrame) -> DataFrame:
    """id, key of the documents that hold a passage of over 50 words which another document holds too, stored."""
    _, places, read = repeated(docs, PASSAGE)
    out = stored(places.select("id", "key").distinct(), "suffix-sharing")
    dropped(docs.sparkSession, *read)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, kept, n_bytes, n_removed, n_spans of every row."""
    lost = repeated_spans(docs)[0].dropDuplicates(["id", "key"])
    return identified(docs).join(lost, ["id", "key"], "left").select(
        "doc_id", F.coalesce("kept", F.encode("text", "UTF-8")).alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans")
    )


def digests(docs: DataFrame) -> DataFrame:
    """The same with the SHA-256 of the kept bytes in their place, and shared; only digests are joined, not texts."""
    lost, read = repeated_spans(docs)
    lost = lost.groupBy("id", "key").agg(F.max("n_removed").alias("n_removed"), F.max("n_spans").alias("n_spans"), F.max(F.sha2("kept", 256)).alias("sha"))
    lost = stored(lost, "suffix-lost")
    dropped(docs.sparkSession, *read)
    lost = lost.join(sharing(docs).withColumn("shared", F.lit(True)), ["id", "key"], "full_outer")
    whole = identified(docs).select("doc_id", "id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("all_sha"))
    return whole.join(lost, ["id", "key"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "all_sha").alias("kept_sha256"), F.coalesce("shared", F.lit(False)).alias("shared")
    )
