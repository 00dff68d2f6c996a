import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import accounting, graph, pricing, reports, usage
from tallyforge.sources import imports

CARD = "SELECT 'm' AS model, '{provider}' AS provider, CAST(NULL AS TIMESTAMP_NTZ) AS effective_from, CAST(NULL AS TIMESTAMP_NTZ) AS effective_until, CAST(1 AS DECIMAL(10,4)) AS rate_input, CAST(0.1 AS DECIMAL(10,4)) AS rate_read, CAST({own} AS DECIMAL(10,4)) AS rate_5m, CAST({own} AS DECIMAL(10,4)) AS rate_1h, CAST(22 AS DECIMAL(10,4)) AS rate_output, CAST(2 AS DECIMAL(8,4)) AS fast_multiplier"


def priced(spark, provider="anthropic", own="1.25", **row):
    base = {"model": "m", "ts": None, "input": 25000, "cache_read": 20000, "cache_write": 4000, "write_5m": 4000, "write_1h": 0, "output": 500, "reasoning": None, "speed": None, "service_tier": None, "geo": None, "provider": None} | row
    kinds = "model string, ts timestamp_ntz, input long, cache_read long, cache_write long, write_5m long, write_1h long, output long, reasoning long, speed string, service_tier string, geo string, provider string"
    r = pricing.priced(pricing.effective(spark.createDataFrame([tuple(base.values())], kinds), spark.sql(CARD.format(provider=provider, own=own)))).first()
    return r.status, r.lower_cost


def test_price_dimensions(spark):
    assert priced(spark) == ("priced", Decimal("0.019000000000"))
    assert priced(spark, geo="us")[1] == Decimal("0.020900000000") and priced(spark, "openai", geo="us")[1] == Decimal("0.019000000000")
    assert priced(spark, geo="eu")[0] == priced(spark, "openai", geo="eu")[0] == "geography_rate_not_established" and priced(spark, "zai", geo="eu")[0] == "priced"
    assert priced(spark, service_tier="priority")[1] == Decimal("0.038000000000") and priced(spark, service_tier="batch")[0] == "unsupported_service_tier" and priced(spark, speed="ultrafast")[0] == "unknown_speed_rate"
    assert priced(spark, model="z")[0] == "unknown_model" and priced(spark, reasoning=501)[0] == "invalid_token_subsets"
    assert priced(spark, own="0")[1] == Decimal("0.018000000000")  # cache writes without a price of their own cost the input's


def test_provider_mismatch(spark):
    row = spark.createDataFrame([("m", None, 10, 1, "Z.ai"), ("m", None, 10, 1, "Anthropic"), ("m", None, 10, 1, None)], "model string, ts timestamp_ntz, input long, output long, provider string")
    row = row.withColumns({c: F.lit(None).cast("long") for c in ("cache_read", "cache_write", "write_5m", "write_1h")} | {c: F.lit(None).cast("string") for c in ("speed", "geo")})
    got = pricing.priced(pricing.effective(row, spark.sql(CARD.format(provider="anthropic", own="1.25")))).collect()
    assert [r.status.replace("range", "priced") for r in sorted(got, key=lambda r: r.provider or "")] == ["priced", "priced", "provider_model_mismatch"]


def quota(spark, observations, requests, **more):
    t = datetime(2026, 1, 1)
    q = [("a", "local", "p", t + timedelta(hours=9), 60, None, t + timedelta(minutes=m), u) for m, u in observations]
    r = [("a", None, t + timedelta(minutes=m), model, None, None, route, n, 10) for m, model, route, n in requests]
    quotas = spark.createDataFrame(q, "agent string, account string, bucket string, resets_at timestamp_ntz, window_minutes int, provider string, observed_at timestamp_ntz, used_percent double")
    rows = spark.createDataFrame(r, "agent string, account string, ts timestamp_ntz, model string, speed string, service_tier string, provider string, input_tokens long, output_tokens long")
    return tuple(accounting.quota_estimates(quotas, rows, **more).select("reason", "tokens", "points").first())


def test_quota_estimates(spark):
    up = [(100, 10.0), (101, 12.0), (102, 13.0), (103, 14.0), (104, 20.0), (105, None)]
    inside = [(100, "m", None, 999), (101, "m", None, 90), (104, "m", None, 190)]
    assert quota(spark, up, inside) == ("calibrated", 300, 10.0)  # the first observation's instant is outside, the last one's inside
    assert quota(spark, up, inside, complete=False)[0] == "coverage_not_declared"
    assert quota(spark, up[1:], inside)[0] == "too_few_observations" and quota(spark, [(m, u / 10 if u else u) for m, u in up], inside)[0] == "too_few_observations"
    assert quota(spark, [*up[:3], (103, 5.0), up[4]], inside)[0] == "quota_fell"
    assert quota(spark, up, [*inside, (102, "other", None, 1)])[0] == quota(spark, up, [*inside, (42, "m", None, 1)])[0] == quota(spark, up, [*inside, (103, "m", None, None)])[0] == "mixed_aging_or_incomplete"
    assert quota(spark, up, [(101, "m", "zai", 90)])[0] == "route_unknown_or_other" and quota(spark, up, [])[0] == "mixed_aging_or_incomplete"


def test_sessions_are_those_of_an_agent(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1)], "agent string, session_id int").withColumns({c: F.lit(1).cast("long") for c in ("input_tokens", "cache_read_tokens", "output_tokens", "request_count")})
    assert rows.agg(*usage.statistics()).first().sessions == 2
    assert {r.label: r.model for r in accounting.session_models(rows.withColumn("model", F.monotonically_increasing_id().cast("string"))).collect()}["b:1"] == "mixed models"


def test_ranks(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    pref = spark.createDataFrame([("a", 3.0), ("c", 1.0)], "node string, pref double")
    got = {r.node: r["rank"] for r in graph.pagerank(nodes, edges, pref).collect()}
    want = dict.fromkeys("abc", 1 / 3)
    for _ in range(300):
        want = {"a": 0.15 * 0.75 + 0.85 * (want["b"] + want["c"]), "b": 0.85 * want["a"], "c": 0.15 * 0.25}
    assert all(abs(got[n] - want[n]) < 1e-5 for n in got)
    assert {round(r["rank"], 9) for r in graph.pagerank(nodes, edges, pref, rounds=3).collect()} == {round(1 / 3, 9)}  # it has not come to rest
    names = spark.createDataFrame([("Settings", 1), ("_private_name", 1), ("kebab-case", 1), ("short_n", 1), ("ALLCAPS1", 1), ("plainname", 9), ("__12345678", 1)], "i string, d int")
    factors = {r.i: round(r.f, 6) for r in names.select("i", graph.naming_factor(F.col("i"), F.col("d"), ["plainname"]).alias("f")).collect()}
    assert factors == {"Settings": 10.0, "_private_name": 1.0, "kebab-case": 10.0, "short_n": 1.0, "ALLCAPS1": 1.0, "plainname": 1.0, "__12345678": 0.1}
    defs = spark.createDataFrame([("f", "x"), ("g", "x"), ("g", "y")], "path string, ident string")
    own = graph.reference_edges(defs, defs.limit(0))
    assert own.count() == 5  # nothing refers to anything: definitions stand for references


def test_imports(spark):
    good = {"schema_version": 1, "usage": [{"agent": "a", "session_id": "s", "timestamp": "2026-01-01T00:00:00.1239Z", "input_tokens": 5, "extra": 1}, {"agent": "a", "session_id": "s", "id": "own", "request_count": 3, "model": "sk-secret"}]}
    read = lambda v: imports.imported(spark.createDataFrame([(json.dumps(v),)], "value string"))
    rows = {r.id: r for r in read(good).collect()}
    assert rows["own"].request_count == 3 and rows["own"].model == "unknown" and len(rows) == 2
    other = next(r for i, r in rows.items() if i != "own")
    assert (other.input_tokens, other.request_count, str(other.ts)) == (5, 1, "2026-01-01 00:00:00.123000") and len(other.id) == 24
    for wrong in ({"schema_version": 2, "usage": []}, good | {"usage": [{"agent": "a", "session_id": "s", "timestamp": "2026-01-01T00:00:00"}]}, good | {"usage": [{"agent": "a", "session_id": "s", "input_tokens": -1}]}, good | {"usage": [{"agent": "a"}]}):
        with pytest.raises(Exception, match="schema_version|offset|negative|session"):
            assert not read(wrong).collect() or read(wrong).collect() is None


def test_quota_snapshots(spark):
    rows = [("claude", None, "2026-01-01T00:00:00Z", {"rate_limits": {"five_hour": {"used_percentage": 12.5, "resets_at": 1767240000}, "odd": 3, "over": {"used_percent": 130}}}), ("grok", "me", "2026-01-01T00:00:00Z", {"quota": {"day": {"remaining_fraction": 0.25}}}), ("codex", "me", None, {"rateLimits": {"primary": {"usedPercent": 7, "windowDurationMins": 300}}})]
    got = imports.quota_snapshot(spark.createDataFrame([(a, c, t, json.dumps(v)) for a, c, t, v in rows], "agent string, account string, observed_at string, value string")).collect()
    assert {(r.agent, r.account, r.bucket, r.window_minutes, r.used_percent) for r in got} == {("claude", "local", "five_hour", 300, 12.5), ("grok", "me", "day", None, 75.0), ("codex", "me", "codex:primary", 300, 7.0)}


def test_discovery_collection_and_report(spark, tmp_path):
    log = tmp_path / "home" / "projects" / "p"
    log.mkdir(parents=True)
    line = lambda n, out: json.dumps({"type": "assistant", "sessionId": "s", "requestId": f"r{n}", "timestamp": "2026-01-01T00:00:00Z", "message": {"id": f"m{n}", "model": "x", "usage": {"input_tokens": 3, "output_tokens": out}}})
    (log / "a.jsonl").write_text("\n".join([line(1, 4), line(2, 5), "{broken"]) + "\n")
    (log / "b.jsonl").write_text(line(1, 9) + "\n")
    (tmp_path / "home" / "other.jsonl").write_text(line(7, 7))
    root = f"file://{tmp_path}/home"
    assert [f.rsplit("/", 1)[1] for f in imports.discovered(spark, "claude", root)] == ["a.jsonl", "b.jsonl"] and imports.collected(spark, "codex", root) is None
    rows, quality = imports.collected(spark, "claude", root)
    assert sorted((r.input_tokens, r.output_tokens) for r in rows.collect()) == [(3, 5), (3, 9)]
    assert sorted((r.lines, r.malformed_rows) for r in quality.collect()) == [(1, 0), (3, 1)]
    out = reports.written({"usage": rows, "quality": quality}, f"file://{tmp_path}/report", ("json", "parquet"))
    assert len(out) == 4 and spark.read.json(out["usage.json"]).count() == 2 and spark.read.parquet(out["quality.parquet"]).count() == 2
    found = spark.createDataFrame([(i,) for i in range(10)], "id int")
    sound = lambda *ids, percent=30: reports.consistent(found, spark.createDataFrame([(i,) for i in ids], "id int"), "id", percent).first().sound
    assert sound(1, 2, 3) and not sound(1, 2, 3, 4) and not sound(1, 1) and not sound(1, 77) and sound(1, percent=0)


def test_equal_requests_are_priced_once(spark, tmp_path):
    from tallyforge.plans import queries

    names = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    rows = [(i, 1 + i % 7, i % 11, 1.0 + i % 3, "ARN"[i % 3], "FO"[i % 2], datetime(1992 + i % 5, 1, 1)) for i in range(4000)]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = pricing.priced(pricing.effective(queries.requests(spark, str(tmp_path)), queries.card(spark))).select("model", queries.E7("lower_cost"), queries.E7("upper_cost"))
    want = {}
    for r in found.collect():
        old = want.get(r.model, (0, 0, 0, 0))
        want[r.model] = (old[0] + (r.lower_e7 or 0), old[1] + (r.upper_e7 or 0), old[2] + (r.lower_e7 is not None), old[3] + (r.lower_e7 is None))
    got = queries.usage_costs(spark, str(tmp_path))
    assert {r.model: tuple(r)[1:] for r in got.collect()} == want and want["A"][0] > 0
    assert "request_count" in got._jdf.queryExecution().optimizedPlan().toString() and pricing.counted(pricing.effective(queries.requests(spark, str(tmp_path)), queries.card(spark)), "l_orderkey", "l_linenumber", "ts").count() < 2400
