"""Usage analytics: statistics with explicit unknowns, groupings, rolling totals, merges, preferences and quotas.

Unknown is null, never zero; a sum is null only if the group has rows and all of them are null. Every operator is
DataFrame -> DataFrame; sums combine on the map side, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTERS = ("input_tokens", "cache_read_tokens", "output_tokens")


def from_events(events: DataFrame) -> DataFrame:
    """The event stream read as usage rows: user = session, event type = agent, value = input, props.k = cache read and output."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("agent"),
        F.concat(F.lit("model-"), (F.col("user_id") % 5).cast("string")).alias("model"),
        "ts",
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("input_tokens"),
        F.when(F.col("user_id") % 7 != 0, k).alias("cache_read_tokens"),
        F.when(F.col("event_id") % 11 != 0, k * 2).alias("output_tokens"),
        F.when(F.col("event_id") % 13 != 0, F.lit(1).cast("long")).alias("request_count"),
    )


def statistics() -> list[Column]:
    """AGG-01 and AGG-02 as aggregates of one group; a session is one of its agent."""
    reported = F.col("input_tokens").isNotNull() & F.col("cache_read_tokens").isNotNull()
    inp, out = F.sum("input_tokens"), F.sum("output_tokens")
    missing = F.count_if(F.col("input_tokens").isNull() | F.col("output_tokens").isNull() | F.col("request_count").isNull())
    return [
        *[F.when(F.count(F.lit(1)) == 0, F.lit(0).cast("long")).otherwise(F.sum(c)).alias(c) for c in COUNTERS],
        F.sum(F.coalesce("request_count", F.lit(1))).alias("requests"),
        F.count_distinct(F.struct("agent", "session_id")).alias("sessions"),
        F.when(inp.isNotNull() | out.isNotNull(), F.coalesce(inp, F.lit(0)) + F.coalesce(out, F.lit(0))).alias("total_tokens"),
        F.floor(F.try_divide(F.lit(10000) * F.sum(F.when(reported, F.col("cache_read_tokens"))), F.sum(F.when(reported, F.col("input_tokens"))))).cast("long").alias("cache_hit_basis_points"),
        missing.alias("rows_with_unknowns"),
        F.sum(F.when(F.col("input_tokens").isNull() | F.col("output_tokens").isNull(), F.coalesce("request_count", F.lit(1))).otherwise(0)).alias("missing_usage_requests"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in COUNTERS],
        F.when(missing > 0, "known lower bound").otherwise("reported/reconstructed").alias("count_quality"),
    ]


def grouped(usage: DataFrame, *keys: Column | str) -> DataFrame:
    """AGG-03, AGG-05: statistics by label."""
    return usage.groupBy(*keys).agg(*statistics())


def dated(usage: DataFrame, pattern: str, tz: str = "UTC") -> DataFrame:
    """AGG-04: a column `label` with the local day or month, `undated` without a timestamp."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), tz)
    return usage.withColumn("label", F.coalesce(F.date_format(local, pattern), F.lit("undated")))


def within(usage: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """FLT-08: start <= ts < end; rows without a timestamp drop out where a bound is set."""
    if start:
        usage = usage.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return usage.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz")) if end else usage


def rollup_sets(usage: DataFrame) -> DataFrame:
    """AGG-03 to AGG-06 in one scan: grouping sets by day, agent, model and in all."""
    rows = usage.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "agent", "model", "input_tokens")
    sets = rows.groupingSets([["day"], ["agent"], ["model"], ["agent", "model"], []], "day", "agent", "model")
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.sum("input_tokens").alias("input_tokens"), F.count(F.lit(1)).alias("n"))


def cost_statistics() -> list[Column]:
    """AGG-01, costs: bounds (what is unpriced adds nothing), and requests that are priced and unpriced."""
    calls = F.coalesce("request_count", F.lit(1))
    unpriced = F.col("lower_cost").isNull()
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return [zero("lower_cost"), zero("upper_cost"), F.sum(F.when(unpriced, 0).otherwise(calls)).alias("priced_requests"), F.sum(F.when(unpriced, calls).otherwise(0)).alias("unpriced_requests")]


def rolling_totals(usage: DataFrame, now: str, spans: dict[str, int]) -> DataFrame:
    """AGG-08: statistics of the closed interval [now - span, now] (seconds) for each span, whatever the report's period; one scan."""
    at = F.lit(now).cast("timestamp_ntz")
    age = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    hits = F.array_compact(F.array(*[F.when(F.col("age") <= s * 1_000_000, F.lit(n)) for n, s in spans.items()]))
    rows = usage.filter(F.col("ts") <= at).withColumn("age", age).filter(F.col("age") <= max(spans.values()) * 1_000_000)
    return rows.withColumn("span", F.explode(hits)).groupBy("span").agg(*statistics())


def anchored_totals(usage: DataFrame, spans: dict[str, int]) -> DataFrame:
    """AGG-09: per agent, totals of the half-open (latest - span, latest]."""
    latest = usage.groupBy("agent").agg(F.max("ts").alias("latest"))
    age = F.unix_micros(F.col("latest").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    rows = usage.join(F.broadcast(latest), "agent").withColumn("age", age)  # one row an agent
    return rows.groupBy("agent").agg(*[F.sum(F.when(F.col("age") < s * 1_000_000, F.col("input_tokens"))).alias(n) for n, s in spans.items()])


def compared_periods(usage: DataFrame, key: str, bounds: tuple[str, str, str]) -> DataFrame:
    """AGG-10: the half-open periods bounds[0..1] and bounds[1..2], and the change in thousandths."""
    a, b, c = (F.lit(x).cast("timestamp_ntz") for x in bounds)
    before, now = (F.sum(F.when((F.col("ts") >= lo) & (F.col("ts") < hi), F.col("input_tokens"))) for lo, hi in ((a, b), (b, c)))
    return usage.groupBy(key).agg(before.alias("before"), now.alias("now")).withColumn("change_thousandths", F.floor(F.try_divide(F.lit(1000) * (F.col("now") - F.col("before")), F.col("before"))).cast("long"))


def ranked_tools(usage: DataFrame) -> DataFrame:
    """AGG-11, SORT-06: calls, characters and tokens (half-even quarter), largest first, unknown last."""
    n = F.sum("input_tokens")
    out = usage.groupBy("agent", "model").agg(F.count(F.lit(1)).alias("calls"), n.alias("characters"), F.bround(n / 4.0, 0).cast("long").alias("tokens"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("agent").orderBy(F.col("characters").desc_nulls_last(), "model")))


def coalesced(rows: DataFrame, key: list[str], order: str, counters: list[str], labels: list[str]) -> DataFrame:
    """AGG-12: one row per identity: the largest of each counter; the first known of each label in order."""
    first = [F.min_by(x, F.when(F.col(x).isNotNull() & (F.col(x) != "unknown"), F.col(order))).alias(x) for x in labels]
    return rows.groupBy(*key).agg(*[F.max(c).alias(c) for c in counters], *[F.coalesce(f, F.lit("unknown")).alias(x) for f, x in zip(first, labels, strict=True)])


def merged(rows: DataFrame, key: str, order: list[str], latest: list[str], largest: list[str]) -> DataFrame:
    """AGG-13, SET-02: of the datasets' rows for a key, some columns from the last in order, counters as maxima."""
    last = F.max_by(F.struct(*latest), F.struct(*order))
    out = rows.groupBy(key).agg(last.alias("last"), *[F.max(c).alias(c) for c in largest])
    return out.select(key, *[F.col(f"last.{c}").alias(c) for c in latest], *largest)


def extents(usage: DataFrame) -> DataFrame:
    """AGG-14, WIN-21: first and last instant and rows of each session."""
    return usage.groupBy("session_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))


def overlapping(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """AGG-07: sessions that overlap a period; the end of a session is inclusive."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return sessions.filter((F.col("ended") >= lo) & (F.col("started") < hi))


def preferred(first: DataFrame, second: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """AGG-15, JOIN-19: two accounts of the same keys; the second is kept where it is nowhere smaller and somewhere larger."""
    a = first.select(key, *[F.col(m).alias(f"a_{m}") for m in measures], F.lit(True).alias("in_a"))
    b = second.select(key, *[F.col(m).alias(f"b_{m}") for m in measures], F.lit(True).alias("in_b"))
    both = a.join(b, key, "full_outer")
    nowhere, somewhere = F.lit(True), F.lit(False)
    for m in measures:
        x, y = F.coalesce(f"a_{m}", F.lit(0)), F.coalesce(f"b_{m}", F.lit(0))
        nowhere, somewhere = nowhere & (y >= x), somewhere | (y > x)
    use_b = F.col("in_a").isNull() | (F.col("in_b").isNotNull() & nowhere & somewhere)
    return both.select(key, F.when(use_b, "second").otherwise("first").alias("source"), *[F.when(use_b, F.col(f"b_{m}")).otherwise(F.col(f"a_{m}")).alias(m) for m in measures])


def composition(turns: DataFrame, ratio: float = 4.0) -> DataFrame:
    """AGG-17, AGG-18: characters and token estimates (half-even, lower /6, upper /2) by conversation and category."""
    n = F.sum(F.length(F.coalesce("text", F.lit(""))))
    out = turns.groupBy("conv_id", F.col("role").alias("category")).agg(n.alias("characters"), F.max("turn").alias("latest_turn"))
    c = F.col("characters")
    return out.withColumns({"tokens": F.bround(c / ratio, 0).cast("long"), "lower_tokens": F.floor(c / 6).cast("long"), "upper_tokens": F.ceil(c / 2).cast("long")})


def histogram(rows: DataFrame, code: str, source: str) -> DataFrame:
    """AGG-19: occurrences and distinct sources of each code."""
    return rows.groupBy(code).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(source).alias("sources"))
