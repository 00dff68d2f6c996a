import hashlib
import json
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import sharding, toolcalls

SCHEMAS = {"get": {"type": "object", "required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string", "maxLength": 5}, "n": {"type": "integer", "minimum": 1}, "of": {"type": "object"}}}}


def frames(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    return c, spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")


CALLS = [
    (1, 1, "a", "get", '{"q": "x", "n": 2.0}', None),
    (1, 3, "b", "get", '{"n": 0, "q": "toolong", "z": 1}', ["a"]),
    (1, 2, "c", "get", '{"q": "é", "of": {"$call": "b"}}', ["missing"]),
    (1, 9, "x", "get", '{"q": "1"}', ["y"]),
    (1, 9, "y", "get", '{"q": "1"}', ["x"]),
    (1, 9, "after", "get", '{"q": "1"}', ["x"]),
    (2, 1, "a", "other", "{}", None),
    (2, 1, None, "get", "{broken", None),
    (2, 5, "a", "get", '{"q": "again"}', None),
    (None, 1, "n", "get", None, None),
]
RESULTS = [(1, 5, "a", "one"), (1, 2, "b", None), (1, 7, "a", "second"), (2, 9, "lost", "?"), (2, 3, None, "no id"), (1, 1, "c", '"q"'), (1, 3, "x", "r"), (1, 3, "y", "r")]


def test_linking(spark):
    calls, results = frames(spark, CALLS, RESULTS)
    rows = toolcalls.linked(calls.withColumn("found", F.lit(1)), results, SCHEMAS).collect()
    by = {(r.conv_id, r.call_id, r.call_turn, r.result_turn): r for r in rows}
    assert len(rows) == len(by) == 13
    a, b, c = by[1, "a", 1, 5], by[1, "b", 3, 2], by[1, "c", 2, 1]
    assert (a.depth, b.depth, c.depth) == (0, 1, 2) and a.status == b.status == c.status == "linked"
    assert a.faults == [] and b.faults == ["$.n: below minimum", "$.q: too long", "$.z: unexpected"] and c.faults == []
    assert a.line == '{"arguments":{"n":2,"q":"x"},"conversation":1,"id":"a","name":"get","result":"one"}'
    assert by[1, "x", 9, 3].status == by[1, "y", 9, 3].status == by[1, "after", 9, None].status.replace("no_result", "cyclic") == "cyclic"
    assert by[1, "after", 9, None].depth is None
    assert by[1, "a", None, 7].status == "repeated" and by[2, "a", 5, None].status == "repeated" and by[2, "a", 1, None].faults == ["unknown_tool"]
    assert by[2, "lost", None, 9].status == by[2, None, None, 3].status == "no_call" and by[2, None, 1, None].faults == ["malformed"]
    assert by[None, "n", 1, None].faults == ["malformed"] and all(json.loads(r.line)["id"] == r.call_id for r in rows)


def test_empty(spark):
    calls, results = frames(spark, [], [])
    assert toolcalls.linked(calls, results, SCHEMAS).count() == 0


def test_turns(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "hi there"), (1, 2, "assistant", "yo"), (1, 3, "user", None), (2, 0, "assistant", "alone")], "conv_id long, turn long, role string, text string")
    calls, results = toolcalls.turns(rows)
    got = {(r.conv_id, r.call_turn, r.result_turn): (r.status, r.depth, r.faults) for r in toolcalls.linked(calls, results, toolcalls.REPLY).collect()}
    assert got == {(1, 1, 2): ("linked", 0, []), (1, 3, None): ("no_result", 1, ["$.prompt: too short"]), (2, None, 0): ("no_call", None, [])}


def brute_depths(edges):
    needs, out = {}, {}
    for a, b in edges:
        needs.setdefault(a, set()).add(b)
    nodes = set(needs)
    for _ in range(len(nodes) + 1):
        for n in nodes - set(out):
            if all(m in out or m not in nodes for m in needs[n]):
                out[n] = 1 + max(out.get(m, 0) for m in needs[n])
    return {n: out.get(n) for n in nodes}


def test_depths_of_random_graphs(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(6):
        n = 40
        edges = {(f"c{i}", f"c{rng.randrange(i)}") for i in range(1, n) for _ in range(rng.choice([1, 1, 1, 2, 3]))}
        edges |= {(f"l{i}", f"l{i - 1}") for i in range(1, 70)} | {("l0", "c39")}  # a long chain behind the others
        if conv % 2:
            edges |= {("c7", "c20"), ("x", "x"), ("y", "x"), ("z1", "z2"), ("z2", "z1"), ("z3", "z1"), ("c12", "z3")}  # cycles, and what is behind them
        rows += [(conv, a, b) for a, b in edges]
        want |= {(conv, k): d for k, d in brute_depths(edges).items()}
    got = toolcalls.depths(spark.createDataFrame(rows, "conv_id long, call_id string, needs string"))
    assert {(r.conv_id, r.call_id): r.depth for r in got.collect()} == want


def test_odd_arguments_are_malformed_or_escaped(spark):
    texts = {"big": '{"n": 1e400}', "nan": '{"n": NaN}', "deep": "[" * 3000 + "]" * 3000, "deeper": "[" * 200_000, "alone": '{"q": "a\\ud800b"}', "long": '{"q": "' + "x" * 3_000_000 + '"}', "int": '{"q": "x", "n": ' + "9" * 400 + "}", "none": None, "call": '{"of": {"$call": "\\ud800"}, "q": "x"}'}
    calls, results = frames(spark, [(1, k, name, "get", t, None) for k, (name, t) in enumerate(texts.items())], [])
    by = {r.call_id: r for r in toolcalls.linked(calls, results, SCHEMAS).collect()}
    assert all(by[x].faults == ["malformed"] for x in ("big", "nan", "deep", "deeper", "none"))
    assert by["alone"].faults == [] and "a\\ud800b" in by["alone"].line and by["long"].faults == ["$.q: too long"] and by["call"].depth == 0
    assert all(json.loads(r.line)["id"] == i for i, r in by.items()) and json.loads(by["big"].line)["arguments"] == texts["big"]


def test_repeats_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "TURNS", 4)
    rows = [(1, t, ("user", "assistant", "assistant")[t % 3], f"t{t}") for t in range(60)] + [(1, 3, "user", "t3"), (2, 5, "user", None), (None, 1, "user", "x"), (3, None, "assistant", "y")]
    calls, results = toolcalls.turns(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, asked int"))
    got = toolcalls.linked(calls, results, toolcalls.REPLY).collect()
    assert len(got) == 20 + 1 + 20 + 3 and Counter(r.status for r in got) == {"linked": 20, "repeated": 21, "no_result": 2, "no_call": 1}
    assert {r.call_turn: r.depth for r in got if r.status == "linked"} == {3 * i: i for i in range(20)}


def test_lookup_is_even_and_steady():
    names = [f"s{i}" for i in range(17)]
    table = sharding.lookup(names, 1009)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1 and len(share) == 17
    fewer = sharding.lookup(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 16)
    assert moved < 0.25 * 1009
    assert [names[i] for i in table] == [names[::-1][i] for i in sharding.lookup(names[::-1], 1009)]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup(bad)


def test_placement(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (1, "w")], "doc_id long, shard string")
    got = sharding.placed(df, "doc_id", ["a", "b", "c"]).collect()
    names, table = ["a", "b", "c"], sharding.lookup(["a", "b", "c"])
    assert len(got) == 4 and all(r.shard == names[table[r.slot]] for r in got) and len({r.slot for r in got if r.doc_id == 1}) == 1
    assert sharding.placed(df.limit(0), "doc_id", names).count() == 0


def test_placement_by_a_second_way(spark):
    """Slots by the xxhash package, and turns by walking each shard's whole permutation."""
    names, size = ["one", "two\nlines", "é", "d", "e"], 101
    orders = {}
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        first, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        orders[n] = [(first + k * skip) % size for k in range(size)]
        assert sorted(orders[n]) == list(range(size))
    taken = {}
    while len(taken) < size:
        for n in sorted(names):
            if len(taken) < size:
                taken[next(s for s in orders[n] if s not in taken)] = n
    rows = [(i, "x") for i in range(-50, 300)] + [(None, "y"), (7, None), (10**18, "long " * 100_000)]
    got = sharding.placed(spark.createDataFrame(rows, "doc_id long, Slot string"), "doc_id", names, size)
    assert got.columns == ["doc_id", "slot", "shard"]
    for r in got.collect():
        key = "\0null" if r.doc_id is None else str(r.doc_id)
        assert r.slot == xxhash.xxh64_intdigest(key.encode(), seed=42) % 2**64 % size or r.slot == (xxhash.xxh64_intdigest(key.encode(), seed=42) - 2**64) % size
        assert r.shard == taken[r.slot]
    keys = spark.createDataFrame([("k" * 200_000,), ("",), (None,)], "key string")
    assert sharding.placed(keys, "key", names, size).count() == 3
