import hashlib
import random
from collections import Counter

import numpy as np

from tallyforge.llm import suffixes


def brute(rows, n=400):
    seen = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        for p in range(len(b) - n + 1):
            seen[hashlib.md5(b[p : p + n]).digest()] += 1
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if seen[hashlib.md5(b[p : p + n]).digest()] > 1:
                gone[p : p + n] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum())
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghé \n") for _ in range(n))
    passages = [text(n) for n in (380, 399, 400, 401, 450, 900, 2500)]
    rows = []
    for i in range(70):
        parts = [text(rng.randrange(0, 700)) for _ in range(rng.randrange(1, 4))]
        for k in range(1, len(parts)):
            parts[k] = (p := rng.choice(passages))[rng.randrange(0, 200) :] + parts[k] if rng.random() < 0.5 else rng.choice(passages) + parts[k]
        rows.append((i, "".join(parts)))
    near = text(3000)
    for k in range(12):
        w = list(near)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = "#"
        rows.append((200 + k, "".join(w)))
    exact = "y" + "".join(rng.choice("pqrstuv") for _ in range(399))
    rows += [(300, "A" + exact), (301, exact), (302, "B" + exact + "C"), (303, exact[1:]), (304, None), (305, ""), (306, "ab" * 700), (307, "q" * 400), (308, "z" * 401), (309, "the " * 300 + "x"), (309, "the " * 300 + "x"), (None, text(500))]
    return rows


def test_spans(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, place int").repartition(3)
    want = brute(rows)
    assert sorted(map(tuple, suffixes.digests(df).drop("shared").collect()), key=str) == want
    monkeypatch.setattr(suffixes, "BUCKET", 40)  # many boundaries
    assert sorted(map(tuple, suffixes.digests(df).drop("shared").collect()), key=str) == want
    kept = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.deduplicated(df).collect()]
    assert sorted(kept, key=str) == want


def brute_sharing(rows, n=51):
    holders = {}
    for k, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        for p in range(len(w) - n + 1):
            holders.setdefault(tuple(w[p : p + n]), set()).add(k)
    out = [False] * len(rows)
    for own in holders.values():
        for k in own if len(own) > 1 else ():
            out[k] = True
    return sorted(((i, s) for (i, _), s in zip(rows, out, strict=True)), key=str)


def test_sharing(spark, monkeypatch):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [words(n) for n in (49, 50, 51, 52, 80, 300)]
    rows = []
    for i in range(60):
        w = words(rng.randrange(0, 120))
        if i % 2:
            w += rng.choice(passages)
        if i % 5 == 0:  # within one document alone
            own = words(60)
            w += own + words(3) + own
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w + words(rng.randrange(0, 90))).replace("w", rng.choice("wW"))))
    rows += [(100, None), (101, ""), (102, "a " * 5000), (103, "b " * 60), (104, " ".join(passages[5][100:151])), (105, "A  " * 51), (None, " ".join(passages[2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_sharing(rows)
    assert sum(s for _, s in want) > 15 and sum(not s for _, s in want) > 15
    for bucket in (1_000_000, 15):
        monkeypatch.setattr(suffixes, "BUCKET", bucket)
        assert sorted(map(tuple, suffixes.digests(df).select("doc_id", "shared").collect()), key=str) == want


def test_empty(spark):
    assert suffixes.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 5, 5000), rng.integers(0, 5, 5000), rng.integers(0, 2**40, 5000)]
    order = suffixes.multikey_order(keys, small=16)
    rows = list(zip(*(k[order].tolist() for k in keys), strict=True))
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(5000))
