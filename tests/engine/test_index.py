import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import code
from tallyforge.operators import indexing
from tallyforge.sources import imports


def test_query_arguments_and_paths():
    indexing.checked_query("x")
    for wrong in ({"question": " "}, {"question": "x" * 8001}, {"question": "x", "mode": "?"}, {"question": "x", "limit": 51}, {"question": "x", "tokens": 10}, {"question": "x", "kind": "?"}):
        with pytest.raises(ValueError):
            indexing.checked_query(**wrong)
    assert code.usage_path("a/usage.json") == "a/usage.json"
    for wrong in ("x/auth.json", "C:\\x\\.env.local", "Credentials.JSON"):
        with pytest.raises(ValueError):
            code.usage_path(wrong)


def test_generations_refresh_and_cache(spark, tmp_path):
    path, rows = f"file://{tmp_path}/index", spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError):
        indexing.snapshot(spark, path)
    assert indexing.published(rows, path, "k") == 1
    old = indexing.snapshot(spark, path)
    assert indexing.published(rows.withColumn("v", F.lit(2)), path, "k") == 2
    (tmp_path / "index" / "generation=3").mkdir()  # not ended
    assert [r.v for r in indexing.snapshot(spark, path).collect()] == [2] and [r.v for r in old.collect()] == [1] and [r.v for r in indexing.snapshot(spark, path, 1).collect()] == [1]
    calls = []
    run = lambda changed, policy="auto": indexing.with_refresh(lambda: calls.append("a") or rows, lambda _: changed, lambda: calls.append("r"), policy)
    for changed, policy, want in ((0, "auto", "a"), (3, "auto", "ara"), (11, "auto", "a"), (3, "off", "a")):
        calls.clear()
        run(changed, policy)
        assert "".join(calls) == want
    files = spark.createDataFrame([("h1", "x"), ("h2", "y")], "hash string, text string")
    tags = lambda df: df.select("hash", F.upper("text").alias("tags"))
    every, fresh = indexing.cached(files, spark.createDataFrame([("h1", "OLD"), ("h9", "Z")], "hash string, tags string"), "hash", tags)
    assert {tuple(r) for r in every.collect()} == {("h1", "OLD"), ("h2", "Y")} and [tuple(r) for r in fresh.collect()] == [("h2", "Y")]


def test_fragments(spark):
    rows = [("python", "import os\n'''doc'''\nfrom a import b", True, False), ("python", "import os\nx = 1", False, False), ("python", "def (", False, False), ("java", "package a.b;\nimport static x.Y.*; // why", True, False), ("java", "// only\n/* this */", True, True), ("java", 'String s = "http://x";', False, False), ("typescript", 'import { a } from "./b";\nconst x = require("y")', True, False), ("c", '#include <stdio.h>\n#include "a.h"', True, False), ("go", 'import (\n"a"\n"b"\n)', True, False), ("java", "* tail\n*/", False, True), ("cobol", "x", False, False)]
    df = spark.createDataFrame([r[:2] for r in rows], "language string, text string").coalesce(1)
    got = df.select(code.preamble(F.col("text"), F.col("language")).alias("p"), code.comment_only(F.col("text"), F.col("language")).alias("c")).collect()
    assert [(r.p, r.c) for r in got] == [r[2:] for r in rows]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(code.properties_text(F.lit("a\\u00e9 \\\\u00e9 \\ud83d\\ude00 \\ud83d"))) == "aé \\\\u00e9 😀 �"
    text = json.dumps({"a": {"api_key": "k", "b": ["xx s3cret yy", {"Cookie": [1]}]}, "n": 1})
    assert json.loads(one(code.scrubbed(F.lit(text), ["s3", "s3cret"]))) == {"a": {"api_key": "[redacted]", "b": ["xx [redacted] yy", {"Cookie": "[redacted]"}]}, "n": 1}
    assert one(code.scrubbed(F.lit("no json s3cret"), ["s3cret"])) == "no json [redacted]"


def test_excerpts_contexts_and_slices(spark):
    text = "alpha\nbeta beta\nthe handlers run\ngamma\ndelta delta delta\n"
    units = spark.createDataFrame([("where is the handler", text, 10, n) for n in (5, 16, 30, 1000)] + [("x", "", 1, 10)], "question string, text string, start_line int, room int")
    got = [(r.room, r.first_line, r.last_line, r.excerpt) for r in code.excerpts(units).orderBy("room").collect()]
    assert got[0][1:] == (None, None, None) and got[2][1:] == (12, 12, "the handlers run") and got[3][1:] == (11, 12, "beta beta\nthe handlers run") and got[4][1:3] == (10, 14)
    lines = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(["# top", "[one]", "  x", "key = 1", "y", "<tag>", "</tag>"])], "path string, line int, value string")
    assert [(r.context, r.context_line) for r in code.config_contexts(lines).orderBy("line").collect()] == [("# top", 1), ("[one]", 2), ("[one]", 2), ("key = 1", 4), ("key = 1", 4), ("<tag>", 6), ("<tag>", 6)]
    files = spark.createDataFrame([("A.java", "l1\nl2\nl3\nl4")], "path string, text string")
    members = spark.createDataFrame([("A.java", "A.java#A.go", "go", "method", 2, 4), ("A.java", "A.java#go", "go", "type", 1, 4)], "path string, id string, name string, kind string, start_line int, end_line int")
    cut = lambda s, n=200: [tuple(r)[1:] for r in code.member_slice(files, members, s, n).collect()]
    assert cut("A.go", 2) == [("A.java#A.go", "2: l2\n3: l3", 1)] and cut("go") == [("A.java#go", "1: l1\n2: l2\n3: l3\n4: l4", 0)] and cut("none") == []


def test_sources(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE assistant_usage_events (id INTEGER, session_id TEXT, model TEXT, input_tokens INTEGER, output_tokens INTEGER, cache_read_tokens INTEGER, cache_write_tokens INTEGER, reasoning_tokens INTEGER, created_at TEXT)")
    con.executemany("INSERT INTO assistant_usage_events VALUES (?, 's', 'm', ?, 5, NULL, 0, 1, '2026-01-02 03:04:05')", [(1, 10), (2, -4)])
    con.commit()
    con.close()
    other = sqlite3.connect(tmp_path / "b.db")
    other.execute("CREATE TABLE t (x)")
    other.commit()
    other.close()
    (tmp_path / "c.db").write_bytes(b"no database at all" * 100)
    got = imports.sqlite_usage(spark, f"file://{tmp_path}/*.db").collect()
    assert sorted((r.file[-4:], r.problem) for r in got if r.problem) == [("b.db", "unsupported_sql_schema"), ("c.db", "sql_snapshot_unreadable")]
    own = sorted((r.input_tokens or -1, r.output_tokens, r.cache_read_tokens, str(r.ts)) for r in got if not r.problem)
    assert own == [(-1, 5, None, "2026-01-02 03:04:05"), (10, 5, None, "2026-01-02 03:04:05")]
    rows = [(10, 2, 1, 5, None, True, 10), (2, 2, 1, 5, None, True, None), (10, 2, 1, 5, None, False, 13), (10, 2, None, 5, 15, None, None), (10, None, None, 5, 16, None, None), (10, None, 0, 5, 15, None, 10), (10, None, None, 5, None, None, 10)]
    df = spark.createDataFrame(rows, "i long, r long, w long, o long, t long, inc boolean, want long")
    assert all(r.want == r.got for r in df.withColumn("got", imports.agy_input(*[F.col(c) for c in ("i", "r", "w", "o", "t", "inc")])).collect())
    good = {"id": "q1", "corpus": "c", "question": "x", "kind": "where", "expected": [{"path": "a", "start": 1, "end": 2}]}
    cases = [(good, "duplicate_id"), (good, "duplicate_id"), (good | {"id": "q2"}, None), (good | {"id": "q3", "kind": "odd"}, "unknown_kind"), (good | {"id": "q4", "expected": []}, "absent_expects_nothing"), (good | {"id": "q5", "kind": "absent", "expected": []}, None), (good | {"id": "q6", "expected": [{"path": "a", "start": 3, "end": 2}]}, "invalid_range"), (good | {"id": "q7", "corpus": " "}, "missing_text"), (good | {"id": "q8", "expected": 3}, "no_list")]
    got = imports.questions(spark.createDataFrame([(json.dumps(c),) for c, _ in cases], "value string")).collect()
    assert sorted((r.id, str(r.problem)) for r in got) == sorted((c["id"], str(p)) for c, p in cases)
    results = {"results": [{"path": "a", "startLine": 1, "endLine": 2, "text": "x\ny\n"}, {"path": "a", "startLine": 1, "endLine": 1, "text": "x\ny"}, {"path": "a", "startLine": 1, "endLine": 1, "text": "x\ny", "lineMapping": "approximate"}, {"path": "", "startLine": 1, "endLine": 1, "text": ""}, {"path": "a", "startLine": 0, "endLine": 1, "text": ""}]}
    got = imports.engine_results(spark.createDataFrame([("q", json.dumps(results))], "question string, value string")).orderBy("place").collect()
    assert [r.problem for r in got] == [None, "text_exceeds_range", None, "missing_path", "invalid_range"]


def test_windows_spans_and_members(spark, tmp_path):
    import random

    one = lambda c: spark.range(1).select(c).first()[0]
    lines = F.array(*[F.lit("x" * n) for n in [3] * 100])
    spans = lambda xs, most: [tuple(r) for r in one(code.overlapping_windows(xs, F.lit(most)))]
    assert spans(lines, 10_000) == [(1, 48), (41, 88), (81, 100)]
    assert spans(F.array(*[F.lit("x" * n) for n in (5, 5, 30, 5)]), 11) == [(1, 2), (3, 3), (4, 4)] and spans(F.array().cast("array<string>"), 5) == []
    text = "one two\n\nthree four five\nsix " + "y" * 40 + '\u0001"'
    got = [tuple(r) for r in one(code.escaped_spans(F.lit(text), F.lit(20)))]
    assert [text[a:b] for a, b in got][:2] == ["one two\n\n", "three four five\n"] and "".join(text[a:b] for a, b in got) == text
    assert all(len(json.dumps(text[a:b])) - 2 <= 20 for a, b in got)
    rng = random.Random(1)
    value = lambda d: rng.choice([1, "a,b}", None, True, {"k": 1}] if d > 2 else [[value(d + 1) for _ in range(2)], {rng.choice("kmn"): value(d + 1) for _ in range(3)}, "q\\\"{"])
    for _ in range(60):
        obj = {k: value(0) for k in rng.sample("abkmn", 4)}
        t = json.dumps(obj, indent=rng.choice([None, 2]))
        for k in "abkmn":
            at = code.member_span(t, k)
            assert (at is None) == (k not in obj) and (at is None or json.loads(t[at[0] : at[1]]) == obj[k])
    assert code.member_span('{"a": 1, "a": 22}', "a") == (14, 16)
    (tmp_path / "a.json").write_text('\ufeff{"x": 1}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text('{"x": ')
    from tallyforge.sources import logs

    assert sorted((r.file[-6:], r.value, r.warning) for r in logs.json_objects(spark, f"file://{tmp_path}/*.json").collect()) == [("a.json", '{"x": 1}', None), ("b.json", None, "malformed_json"), ("c.json", None, "malformed_json")]
