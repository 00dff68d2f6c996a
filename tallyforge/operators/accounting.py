"""Accounts of a report: quota estimates, attribution, scope and gaps, used rates (AGG-05, AGG-06, AGG-07, AGG-16, AGG-37, AGG-38, AGG-40, FLT-10, JOIN-10).

Every operator is DataFrame -> DataFrame; joins are equi-joins with a range condition beside the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.scalars import attribution_rank

#: Warnings that mean that counts are a lower bound.
GAPS = (
    "fork_baseline_unknown native_legacy_overlap_unresolved source_unreadable malformed_or_partial_line malformed_json explicit_export_required "
    "missing_request_identity unsupported_usage_schema checkpoint_exceeds_requests unsupported_sql_schema grok_turn_usage_unavailable "
    "counter_reset_unknown_baseline sql_jsonl_discrepancy sql_snapshot_unreadable missing_request_id_message_fallback "
    "grok_aggregate_unavailable_without_turns agy_aggregate_time_unavailable"
).split()

QUOTA = ["agent", "account", "bucket", "resets_at", "window_minutes", "provider"]


def quota_estimates(quotas: DataFrame, requests: DataFrame, complete: bool = True, least: int = 5, span: float = 5) -> DataFrame:
    """AGG-16, JOIN-10, WIN-08: per quota (agent, account, bucket, resets_at, window_minutes, provider) tokens per point, or the reason why there
    are none. quotas: those columns, observed_at, used_percent; requests: agent, account, ts, model, speed, service_tier, provider, input_tokens,
    output_tokens. Requests of the account count within (first, last] observation; those of the agent a window earlier are aging."""
    valid = F.col("used_percent").isNotNull() & (F.col("used_percent") >= 0) & F.col("observed_at").isNotNull()
    before = F.lag("used_percent").over(Window.partitionBy(*QUOTA).orderBy("observed_at", "used_percent"))
    seen = quotas.filter(valid).withColumn("fell", F.col("used_percent") < before)
    at = F.struct("observed_at", "used_percent")
    groups = quotas.groupBy(*QUOTA).agg(F.count(F.lit(1)).alias("samples"))
    known = seen.groupBy(*QUOTA).agg(F.count(F.lit(1)).alias("valid"), F.coalesce(F.max("fell"), F.lit(False)).alias("fell"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    same = lambda a, b, columns: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])
    groups = groups.join(known, same(groups, known, QUOTA), "left").select(*[groups[c] for c in QUOTA], "samples", "valid", "fell", F.col("lo.observed_at").alias("first"), F.col("hi.observed_at").alias("last"), (F.col("hi.used_percent") - F.col("lo.used_percent")).alias("points"))
    groups = groups.withColumn("quota", F.xxhash64(*QUOTA))
    r = requests.select(F.col("agent").alias("r_agent"), F.coalesce("account", F.lit("local")).alias("r_account"), "ts", F.struct("model", "speed", "service_tier", F.col("provider").alias("p")).alias("mix"), F.col("provider").alias("route"), "input_tokens", "output_tokens")
    inside = groups.join(r, F.col("agent").eqNullSafe(F.col("r_agent")) & F.col("account").eqNullSafe(F.col("r_account")) & (F.col("ts") > F.col("first")) & (F.col("ts") <= F.col("last")))
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    inside = inside.groupBy("quota").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct(F.to_json("mix")).alias("mixes"), F.max((F.col("route").isNotNull() & ~F.col("route").eqNullSafe(F.col("provider"))).cast("int")).alias("other_route"),
        F.max((F.col("provider").isNotNull() & ~F.col("route").eqNullSafe(F.col("provider"))).cast("int")).alias("unconfirmed"), F.max((F.col("input_tokens").isNull() | F.col("output_tokens").isNull()).cast("int")).alias("incomplete"), F.sum(tokens).alias("tokens"),
    )
    earlier = F.make_dt_interval(mins=F.col("window_minutes").cast("int"))
    aging = groups.filter("window_minutes > 0").join(r, F.col("agent").eqNullSafe(F.col("r_agent")) & (F.col("ts") > F.col("first") - earlier) & (F.col("ts") <= F.col("last") - earlier))
    aging = aging.groupBy("quota").agg(F.count(F.lit(1)).alias("aging"))
    rows = groups.join(inside, "quota", "left").join(aging, "quota", "left")
    old = F.coalesce("window_minutes", F.lit(0)).eqNullSafe(0) | (F.coalesce("aging", F.lit(0)) > 0)
    reason = (
        F.when(~F.lit(complete), "coverage_not_declared")
        .when(F.coalesce(F.col("valid") < least, F.lit(True)) | F.col("resets_at").isNull() | (F.col("last") >= F.col("resets_at")), "too_few_observations")
        .when(F.col("fell"), "quota_fell")
        .when(F.col("points") < span, "too_few_observations")
        .when((F.col("other_route") == 1) | (F.col("unconfirmed") == 1), "route_unknown_or_other")
        .when(F.coalesce(F.col("mixes") != 1, F.lit(True)) | old | (F.col("incomplete") == 1), "mixed_aging_or_incomplete")
        .otherwise("calibrated")
    )
    return rows.select(*QUOTA, "samples", reason.alias("reason"), F.when(reason == "calibrated", F.col("tokens")).alias("tokens"), F.when(reason == "calibrated", F.col("points")).alias("points"))


def attribution_label(agent: str = "agent", provider: str = "provider", reported: str = "reported_model", model: str = "model", attribution: str = "model_attribution") -> Column:
    """AGG-05: the five parts of an attribution in one label."""
    known = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return F.concat_ws(" | ", agent, known(provider, "unverified provider"), F.coalesce(reported, model, F.lit("unknown")), known(model, "unknown"), known(attribution, "reported"))


def session_models(usage: DataFrame) -> DataFrame:
    """AGG-06: label (agent:session), the session's model or `mixed models`, rows."""
    model = F.coalesce("model", F.lit("unknown"))
    label = F.concat_ws(":", "agent", F.col("session_id").cast("string"))
    one = F.when(F.min(model) == F.max(model), F.min(model)).otherwise("mixed models")
    return usage.groupBy(label.alias("label")).agg(one.alias("model"), F.count(F.lit(1)).alias("n"))


def gaps(warnings: DataFrame, code: str = "code") -> DataFrame:
    """FLT-10: observations of accounting gaps, and what they make of a count's quality."""
    n = F.count_if(F.col(code).isin(*GAPS))
    return warnings.agg(n.alias("accounting_gap_observations"), F.when(n > 0, "known lower bound").otherwise("reported/reconstructed").alias("count_quality"))


def scope(usage: DataFrame, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """AGG-07, AGG-37, AGG-38, FLT-08: sessions that overlap a period or have rows in it, requests without a confirmed route, rows without an instant."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    rows = usage.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
    over = sessions.filter((F.col("ended").isNull() | (F.col("ended") >= lo)) & (F.col("started").isNull() | (F.col("started") < hi)))
    n = over.select("agent", "session_id").unionByName(rows.select("agent", "session_id")).distinct().agg(F.count(F.lit(1)).alias("sessions"))
    unconfirmed = rows.agg(F.sum(F.when(attribution_rank(F.col("model_attribution")) == 0, F.coalesce("request_count", F.lit(1))).otherwise(0)).alias("unverified_model_requests"))
    undated = usage.agg(F.count_if(F.col("ts").isNull()).alias("undated_requests_excluded"))
    return n.crossJoin(unconfirmed).crossJoin(undated)  # three rows of one


def used_rates(card: DataFrame, aliases: DataFrame, usage: DataFrame) -> DataFrame:
    """AGG-40: the card's rows whose model some row names, by itself or through an alias."""
    named = usage.select(F.col("model").alias("alias")).distinct()
    models = named.join(aliases, "alias", "left").select(F.coalesce("target", "alias").alias("model")).distinct()
    return card.join(models, "model", "left_semi")
