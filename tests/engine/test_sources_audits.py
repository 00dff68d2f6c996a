import json

import pytest

from pyspark.sql import functions as F

from tallyforge.operators.snapshots import run_summary
from tallyforge.sources import audits, repository
from tallyforge.streaming import ledger


def report(lcp, **more):
    audit = lambda i, score, mode="numeric", **x: {"id": i, "title": i.title(), "score": score, "scoreDisplayMode": mode} | x
    listed = [audit("largest-contentful-paint", 0.1, numericValue=lcp), audit("slow", 0.89), audit("fine", 0.9), audit("told", 0.2, "informative"), audit("none", None), audit("alt", 0, "binary"), audit("by-hand", 0, "manual")]
    items = [{"url": "https://a.shop.co.uk/x", "resourceType": "Script", "transferSize": 10}, {"url": "https://cdn.other.net/y", "transferSize": 5}, {"url": "no url"}]
    made = {x["id"]: x for x in listed} | {"network-requests": {"id": "network-requests", "score": None, "details": {"items": items}}}
    refs = lambda *ids: [{"id": i} for i in ids]
    categories = {"performance": {"score": 0.555, "auditRefs": refs("largest-contentful-paint", "slow", "fine", "told", "none", "absent")}, "seo": {"score": None, "auditRefs": refs("alt", "by-hand")}}
    return {"finalUrl": "https://www.shop.co.uk/", "lighthouseVersion": "12", "audits": made, "categories": categories} | more


@pytest.fixture
def folder(tmp_path):
    entities = [{"name": "Other", "isFirstParty": True}]
    for name, body in {"mobile-1": report(900), "mobile-2": report(300), "mobile-3": report(500), "desktop-1": report(100, entities=entities), "tablet-1": report(1)}.items():
        (tmp_path / f"{name}.report.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "mobile-4.json").write_text("{}")
    return f"file://{tmp_path}"


def test_reports(spark, folder):
    rows = audits.reports(spark, folder)
    assert sorted(r.run for r in rows.select("run").collect()) == ["desktop-1.report.json", "mobile-1.report.json", "mobile-2.report.json", "mobile-3.report.json"]
    lcp = audits.metrics(rows).filter("metric = 'LCP' AND value IS NOT NULL")
    summary = {r.form: (r.median, r.least, r.most, r.representative) for r in run_summary(lcp, "form", "run", "value").collect()}
    assert summary == {"mobile": (500, 300, 900, "mobile-3.report.json"), "desktop": (100, 100, 100, "desktop-1.report.json")}
    assert audits.metrics(rows).filter("metric = 'CLS' AND value IS NULL").count() == 4
    assert {(r.category, r.score) for r in audits.scores(rows).collect()} == {("performance", 56), ("seo", 0)}
    assert {(r.category, r.position, r.id) for r in audits.failing(rows).collect()} == {("performance", 1, "slow"), ("seo", 0, "alt")}
    asked = audits.requests(rows).filter("run = 'mobile-1.report.json'").collect()
    assert {(r.type, r.host, r.bytes, r.first_party) for r in asked} == {("Script", "a.shop.co.uk", 10, True), ("Other", "cdn.other.net", 5, False), ("Other", "other", 0, False)}


def test_java_is_read_in_its_own_encoding(spark):
    rows = spark.createDataFrame([("A.java", bytearray("class Ž {}".encode("cp1250"))), ("b.py", bytearray(b"x")), ("c.java", None)], "path string, content binary")
    assert [(r.path, r.text) for r in repository.java_texts(rows, "cp1250").collect()] == [("A.java", "class Ž {}")]
    with pytest.raises(Exception, match="A.java is not utf-8"):
        repository.java_texts(rows).collect()


def test_refresh_follows_changes_alone(spark):
    events = {
        "edit": {"hook_event_name": "PostToolUse", "tool_name": "Edit", "cwd": "/w/repo/src"},
        "read": {"hook_event_name": "PostToolUse", "tool_name": "Read", "cwd": "/w/repo"},
        "own": {"hook_event_name": "AfterTool", "toolName": "mcp__own__search", "cwd": "/w/repo"},
        "else": {"hook_event_name": "Stop", "cwd": "/w/repository"},
        "up": {"hook_event_name": "Stop", "cwd": "/w/repo/../other"},
        "roots": {"hook_event_name": "afterFileEdit", "workspace_roots": ["/w/repo"]},
        "unknown": {"hook_event_name": "PreToolUse", "cwd": "/w/repo"},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in events.items()] + [("bad", "{"), ("null", None)], "name string, value string")
    assert {r["name"] for r in ledger.refresh_due(rows, "/w/repo", "mcp__own__").collect()} == {"edit", "roots"}


def test_medians_of_odd_values(spark, monkeypatch):
    import random
    from collections import defaultdict
    from math import inf, nan, nextafter

    from tallyforge.operators import snapshots

    pick = random.Random(3)
    monkeypatch.setattr(snapshots, "PARTS", 8)
    groups = {"one": [4.0], "two": [4.0, 9.0], "same": [2.0] * 9, "wide": [-1.7e308, 1.7e308, 3.0, 5e-324, 1e300], "near": [1.0, nextafter(1.0, 2.0)] * 3, "tiny": [0.0, 5e-324, 1e-323], "ends": [-inf, 1.0, 2.0, inf, nan], "long": [pick.expovariate(1) * 10 ** pick.randrange(6) for _ in range(200)], "even": [float(pick.randrange(9)) for _ in range(300)], "gap": [1.0, 1.0, 8.0, 9.0], "null": [None, 5.0, None, 7.0, 6.5], "none": [None, None]}
    rows = [(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "form string, run long, value double")
    want = {r.form: (r.m, r.a, r.b, r.n) for r in df.groupBy("form").agg(F.median("value").alias("m"), F.min("value").alias("a"), F.max("value").alias("b"), F.count("value").alias("n")).collect()}
    got = {r.form: ((r.median, r.least, r.most, r.n), r.representative) for r in run_summary(df, "form", "run", "value").collect()}
    assert {k: str(v[0]) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
    by = defaultdict(list)
    for g, i, x in rows:
        by[g].append((x is None, 0 if x is None else abs(x - (want[g][0] or 0)), i))
    for g in set(groups) - {"ends"}:
        assert got[g][1] == min(by[g])[2], g


def test_medians_sort_no_rows(spark):
    df = spark.range(1000).selectExpr("'f' AS form", "id AS run", "double(id % 7) AS value")
    plan = run_summary(df, "form", "run", "value")._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median(" not in plan and "SortAggregate" not in plan
