import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.operators import retrieval


def peak(frame, monkeypatch, build, batches):
    """What a worker gives for the batches, and the MB that it holds at most."""
    runs = []
    call = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: runs.append(f) or call(self, f, schema))
    build()
    tracemalloc.start()
    out = pa.Table.from_batches(list(runs[0](iter(batches))))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


@pytest.mark.parametrize("limit", [3, 60])
def test_vectors_meet_queries_in_slices(spark, monkeypatch, limit):
    rng = np.random.default_rng(1)
    v, q = rng.integers(-2, 3, (10_000, 8)) + 0.5, rng.integers(-2, 3, (400, 8)) + 0.5  # many ties
    empty = spark.createDataFrame([], "id long, v array<double>")
    ask = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query long, q array<double>")
    ids = rng.permutation(10_000)
    batch = pa.record_batch([pa.array(ids), pa.array([""] * len(v)), pa.array(list(v))], ["unit", "group", "v"])
    out, most = peak(type(empty), monkeypatch, lambda: retrieval.cosine_topk(empty, ask, limit), [batch])
    assert most < 80  # all scores of the batch with their places: over 200
    score = np.round((v / np.linalg.norm(v, axis=1)[:, None]) @ (q / np.linalg.norm(q, axis=1)[:, None]).T, 6)
    want = [(k, int(ids[i])) for k in range(len(q)) for i in np.lexsort([ids, -score[:, k]])[:limit]]
    assert list(zip(out["query"].to_pylist(), out["unit"].to_pylist(), strict=True)) == want


def test_more_vectors_than_wait(spark, monkeypatch):
    """Scores that grow from row to row: no later slice is left out."""
    monkeypatch.setattr(retrieval, "SCORES", 64)
    monkeypatch.setattr(retrieval, "WAITING", 16)
    vectors = spark.createDataFrame([(i, [float(i), 100.0]) for i in range(500)], "id long, v array<double>").coalesce(1)
    ask = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query long, q array<double>")
    got = {(r.query, r.place): r.id for r in retrieval.cosine_topk(vectors, ask, 5).collect()}
    assert got == {(1, k): 500 - k for k in range(1, 6)} | {(2, k): k - 1 for k in range(1, 6)}


def test_units_meet_questions_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [[f"w{k}" for k in rng.integers(0, 40, 12)] for _ in range(6000)]
    units = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words[:300])], "id long, text string")
    questions = spark.createDataFrame([(i, f"w{i % 40} w{i * 7 % 40} w{i * 3 % 40}") for i in range(300)], "question long, text string")
    batch = pa.record_batch([pa.array(range(6000)), pa.array([""] * 6000), pa.array(words)], ["unit", "group", "terms"])
    out, most = peak(type(units), monkeypatch, lambda: retrieval.bm25(units, questions, "id", "text", 300), [batch])
    assert most < 80 and len(out) == 90_000  # all scores and matches with their places: over 120
