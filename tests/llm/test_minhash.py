import random

import numpy as np
import pytest
from tallyforge.llm import minhash
from tallyforge.llm.components import components


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    text = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(n)]
    rows, i = [], 0
    for _ in range(12):
        base = text(rng.randrange(30, 200))
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
            rows.append((i, rng.choice([" ", "\n", "  "]).join(w).swapcase()))
            i += 3
    chain = text(100)
    for k in range(20):  # neighbours are similar, the ends are not
        w = list(chain)
        w[: 3 * k] = [f"new{j}" for j in range(3 * k)]
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one two"), (2004, "One  two"), (2005, "two one"), (2006, "é É"), (2007, "é é"), (2008, "w " * 50000), (2009, "w w w w w")]
    return rows


def test_groups(spark):
    rows = corpus()
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_empty_table_and_repeats(spark):
    assert minhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = minhash.near_groups(spark.createDataFrame([(5, "a b", 1), (5, "a b", 1), (4, "A b", 1), (None, "x", 1)], "doc_id long, text string, id int"))
    assert sorted(map(tuple, got.collect()), key=str) == [(4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, None, True)]


def test_estimate_and_merge():
    rng = np.random.default_rng(0)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    sets = [np.concatenate([shared, a]), np.concatenate([shared, b]), np.concatenate([shared, a, b])]
    k = [minhash.registers(s, np.array([0, len(s)]))[0] for s in sets]
    assert (np.maximum(k[0], k[1]) == k[2]).all()  # registers merge
    assert abs(minhash.likely(k[0][None], k[1][None], np.array([700.0]), np.array([700.0]))[0] - 0.75) < 0.12


@pytest.mark.parametrize("chunk", [100_000, 3])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr("tallyforge.llm.components.CHUNK", chunk)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (200, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 300: 200}


def test_just_below_the_threshold(spark, monkeypatch):
    """Many copies of one text, each with its own edits, so that hardly any is similar to the pivot but some are to one another; blocks are small."""
    for name, value in (("SIGNS_BLOCK", 16), ("SETS_BLOCK", 4000), ("LIGHTEST", 200)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):
        w = list(w) if i % 3 == 2 else list(base)  # each third text is close to the one before it
        for _ in range(1 if i % 3 == 2 else 5):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = brute(rows)
    assert {tuple(r) for r in got.collect()} == want
    assert 1 < len({c for _, _, c, _ in want}) < 90


def test_rows_of_a_large_group(spark, monkeypatch):
    """Near copies of one text and four texts just below the threshold: rows that full sets are sent with grow as the group does."""
    for name, value in (("SIGNS_BLOCK", 16), ("SETS_BLOCK", 4000), ("LIGHTEST", 200)):
        monkeypatch.setattr(minhash, name, value)
    sent, real = [], minhash.confirmed

    def counted(rows):
        sent.append(rows.count())
        return real(rows)

    monkeypatch.setattr(minhash, "confirmed", counted)
    last = []
    for copies in (50, 200):
        rng = random.Random(3)
        base = [f"b{i}" for i in range(150)]
        rows = [(0, " ".join(base))]
        for i in range(1, copies):
            w = list(base)
            for at in (10, 40, 70, 100, 130) if i < 5 else (10, 60):
                w[at + rng.randrange(10)] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
        got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        want = brute(rows)
        assert {tuple(r) for r in got.collect()} == want
        assert len({c for _, _, c, _ in want}) == 5
        last.append(sent[-1])
    print("rows sent", last)
    assert 50 <= last[1] <= 5 * last[0]
