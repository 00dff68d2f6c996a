import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing, toxicity

RNG = random.Random(8)
WORDS = [a + b for a in "bcdfgl" for b in ("an", "et", "ilo", "ou", "ura", "em")]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = [], []
    for i in range(900):
        bad, low = i % 5 == 0, i % 7 == 3
        w = [RNG.choice(WORDS) for _ in range(RNG.randrange(20, 80))]
        for _ in range(4 * bad):
            w[RNG.randrange(len(w))] = RNG.choice(["vilest", "awful"])
        for _ in range(4 * low):
            w[RNG.randrange(len(w))] = RNG.choice(["spam", "buy"])
        docs.append((i, " ".join(w), "s"))
        labels.append((i, 0 if low else 1, int(bad)))
    docs += [(None, "null id", "s"), (5000, None, "s"), (5001, "", "s"), (5002, "awful vilest " * 40000, "s"), (5003, WORDS[0] + " x" * 40000, "s")]
    labels += [(3, 1, 0), (None, 1, 1), (9999, 1, 1), (7, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores(tables):
    docs, labels = tables
    rows = toxicity.scored(docs.withColumn("score", F.lit(1)), labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    held = [i for i in range(900) if by[i].held_out]
    assert np.mean([by[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    assert by[5002].predicted == 1 and by[5003].predicted == 0 and by[5000].score == by[5001].score


def test_no_labels_and_empty(spark, tables):
    docs, labels = tables
    none = labels.limit(0)
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), labels).count() == 0 and mixing.rates(docs.limit(0), labels).count() == 0
    assert toxicity.accepted(docs, none).count() == docs.count()


def test_rates_meet_targets(tables):
    docs, labels = tables
    targets = {"good": 0.5, "low": 0.3, "toxic": 0.2}
    rows = mixing.rates(docs, labels, targets).toPandas()
    assert len(rows) == docs.count() and (rows.rate >= 0).all()
    got = {d: (rows.tokens * rows[f"p_{d}"] * rows.rate).sum() / rows.tokens.sum() for d in targets}
    assert all(abs(got[d] - t) < 1e-3 for d, t in targets.items()), got
    assert np.allclose(rows[["p_good", "p_low", "p_toxic"]].sum(axis=1), 1)
    known = rows.set_index("doc_id")
    assert known.p_toxic[0] > 0.5 > known.p_toxic[1] and known.p_low[3] > 0.5 > known.p_low[2]


def test_rates_match_a_plain_solver(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([2, 1, 0.5], 300)
    n = rng.integers(1, 100, 300)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "tokens long, p array<double>")
    targets = {"x": 0.2, "y": 0.2, "z": 0.6}
    steps, missed = mixing.fitted(rows, targets)
    assert missed < 1e-4
    got = np.array([r[0] for r in rows.select(mixing.rate([F.col("p")[i] for i in range(3)], steps, None)).collect()])
    want, m = np.ones(300), (p * n[:, None]).T @ p / n.sum()
    for _ in range(20_000):  # plain projected gradient, step one in the fixed metric
        want = np.maximum(0, want - p @ (np.linalg.inv(m) @ ((p * (n * want)[:, None]).sum(0) / n.sum() - np.array([0.2, 0.2, 0.6]))))
    share = lambda r: (p * (n * r)[:, None]).sum(0) / n.sum()
    assert (got >= 0).all() and np.allclose(share(want), [0.2, 0.2, 0.6], atol=1e-3) and np.allclose(share(got), [0.2, 0.2, 0.6], atol=1e-4)
    assert np.corrcoef(got, want)[0, 1] > 0.97


def test_mixed_rows_keep_columns_and_repeat_none(tables):
    docs, labels = tables
    out = mixing.mixed_rows(docs, labels, {"good": 0.95, "low": 0.03, "toxic": 0.02})
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids))
    low = [i for i in range(900) if i % 7 == 3]
    assert len(set(low) & set(ids)) < 0.6 * len(low)


def test_a_short_domain_shrinks_no_other(spark):
    rows = spark.createDataFrame([(10, p) for p in [[1.0, 0.0, 0.0]] * 90 + [[0.0, 1.0, 0.0]] * 9 + [[0.0, 0.0, 1.0]]], "tokens long, p array<double>")
    steps, missed = mixing.fitted(rows, mixing.TARGETS, 1.0, 1.0, spared=True)
    assert missed < 1e-4
    got = rows.select("p", mixing.rate([F.col("p")[i] for i in range(3)], steps, 1.0).alias("r")).collect()
    assert abs(sum(x.r for x in got if x.p[0]) - 86) < 0.1 and all(x.r > 0.999 for x in got if not x.p[0])


def test_a_miss_is_told(spark, tables):
    docs, labels = tables
    rows = spark.createDataFrame([(10, [1.0, 0.0])] * 9 + [(10, [0.0, 1.0])], "tokens long, p array<double>")
    _, missed = mixing.fitted(rows, {"x": 0.5, "y": 0.5}, 1.0, 1.0)
    assert missed > 0.3  # rates of at most one cannot make half of a tenth
    with pytest.warns(UserWarning, match="mixing leaves"):
        mixing.mixed_rows(docs, labels, {"good": 0.1, "low": 0.1, "toxic": 0.8}, spared=False)
    out = mixing.rates(docs, labels)
    assert "missed" in out.columns


def test_ids_with_several_texts_teach_once(spark, tables):
    docs, labels = tables
    many = docs.unionByName(docs.filter("doc_id < 50").withColumn("text", F.lit("zz other"))).unionByName(docs.filter("doc_id < 50"))
    a = toxicity.trained(docs, labels, [F.col("toxic")])[0]
    b = toxicity.trained(docs.unionByName(docs), labels, [F.col("toxic")])[0]
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert len(toxicity.trained(many, labels, [F.col("toxic")])) == 1
