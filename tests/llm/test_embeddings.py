import numpy as np

from tallyforge.llm import embeddings


def brute(rows):
    good = {}
    for i, (v, x) in enumerate(rows):
        if v is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x):
            good[i] = np.array(x, float) / np.linalg.norm(x)
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.95:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        root = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((v, len(links[i]), root, v == root))
    return sorted(out, key=str)


def test_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(32)
        for _ in range(rng.integers(1, 9)):
            rows.append((3 * len(rows), (base + rng.standard_normal(32) * rng.choice([0.05, 0.2, 0.35])).astype(np.float32).tolist()))
    rows += [(9000 + i, rows[5][1]) for i in range(30)]
    rows += [(1, None), (2, []), (4, [0.0] * 32), (5, [float("nan")] + [1.0] * 31), (7, [None] + [1.0] * 31), (8, [1.0, 2.0]), (10, [2.0, 4.0]), (None, rows[5][1]), (11, [3e38] * 32), (13, [1e-30] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as size")
    assert sorted(map(tuple, embeddings.near_vectors(df).collect()), key=str) == brute(rows)
    monkeypatch.setattr(embeddings, "BLOCK", 3)  # buckets dealt out as pairs of blocks
    assert sorted(map(tuple, embeddings.near_vectors(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(9)
    x = embeddings.unit(rng.standard_normal((400, 64)))
    y = embeddings.unit(x + 0.05 * rng.standard_normal((400, 64)))
    tx, ty = embeddings.turned(x, 64), embeddings.turned(y, 64)
    code = np.sign(tx) / 8
    guess = (np.einsum("nri,nri->nr", ty, code) / np.abs(tx).sum(2) * 8).mean(1)
    assert abs((guess - (x * y).sum(1)).mean()) < 0.005
