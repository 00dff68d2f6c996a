"""Request pricing with effective rates, tiers, multipliers and cost ranges (JOIN-04, JOIN-05, SCL-24).

A rate card has few rows whose number does not grow with the requests; it is broadcast only below CARD_ROWS rows, and joined by shuffle otherwise.
Money is DECIMAL; prices are per million tokens. What is unknown widens the range between lower and upper cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,12)"
CARD_ROWS = 100_000


def _small(card: DataFrame) -> DataFrame:
    return F.broadcast(card) if len(card.take(CARD_ROWS + 1)) <= CARD_ROWS else card


def effective(requests: DataFrame, card: DataFrame, aliases: DataFrame | None = None, model: str = "model", at: str = "ts") -> DataFrame:
    """Each request with the card's row of its model (after aliases) whose half-open effective interval holds its instant, or nulls."""
    card = card.withColumnRenamed("model", "card_model")
    if "provider" in card.columns:
        card = card.withColumnRenamed("provider", "card_provider")
    models = card.select(F.col("card_model").alias("known_as")).distinct()
    requests = requests.withColumn("priced_model", F.col(model))
    if aliases is not None:
        requests = requests.join(_small(aliases.select(F.col("alias").alias("priced_model"), "target")), "priced_model", "left").withColumn("priced_model", F.coalesce("target", "priced_model")).drop("target")
    same = (F.col("card_model") == F.col("priced_model")) & (F.col("effective_from").isNull() | (F.col(at) >= F.col("effective_from"))) & (F.col("effective_until").isNull() | (F.col(at) < F.col("effective_until")))
    known = requests.join(_small(models), F.col("known_as") == F.col("priced_model"), "left").withColumn("known_model", F.col("known_as").isNotNull()).drop("known_as")
    return known.join(_small(card), same, "left")


def with_tier(requests: DataFrame, tiers: DataFrame, key: str, size: str) -> DataFrame:
    """JOIN-05: of the listed tiers whose threshold the size exceeds, the last replaces the base rates."""
    tiers = tiers.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("tier_no", "above", "tier_input", "tier_output"))).alias("tiers"))  # a few a model
    rows = requests.join(_small(tiers), requests[key] == tiers["model"], "left").drop(tiers["model"])
    hit = F.try_element_at(F.filter(F.coalesce("tiers", F.array().cast("array<struct<tier_no:int,above:bigint,tier_input:decimal(20,6),tier_output:decimal(20,6)>>")), lambda t: t["above"] < F.col(size)), F.lit(-1))
    return rows.withColumn("tier", hit).withColumn("rate_input", F.coalesce("tier.tier_input", "rate_input")).withColumn("rate_output", F.coalesce("tier.tier_output", "rate_output")).drop("tiers", "tier")


#: Paces that cost nothing extra, and those that have a multiplier.
PLAIN, QUICK = ("standard", "default", "auto", "normal"), ("fast", "priority", "ultrafast")


def pace() -> Column:
    """Speed, else service tier, else standard."""
    return F.lower(F.coalesce(F.nullif("speed", F.lit("")), F.nullif("service_tier", F.lit("")), F.lit("standard")))


def route(provider: Column) -> Column:
    """A provider's name as the card has it."""
    p = F.lower(provider)
    return F.when(p.isin("z.ai", "z-ai"), "zai").otherwise(p)


def cost() -> tuple[Column, Column]:
    """Lower and upper cost of a request whose input, read, write, write_5m, write_1h and output are columns, by the card's columns."""
    read, out = F.coalesce("cache_read", F.lit(0)), F.coalesce("output", F.lit(0))
    write, w5, w1 = (F.coalesce(c, F.lit(0)) for c in ("cache_write", "write_5m", "write_1h"))
    money = lambda x: x.cast("decimal(17,0)")
    fixed = money(read) * F.col("rate_read") + money(out) * F.col("rate_output") + money(w5) * F.when(F.col("rate_5m") == 0, F.col("rate_input")).otherwise(F.col("rate_5m")) + money(w1) * F.when(F.col("rate_1h") == 0, F.col("rate_input")).otherwise(F.col("rate_1h"))
    rest_write, rest_in = money(write - w5 - w1), money(F.col("input") - read - write)
    five, hour = (F.when(F.col(c) == 0, F.col("rate_input")).otherwise(F.col(c)) for c in ("rate_5m", "rate_1h"))  # no price of its own: the input's
    low_w, high_w = F.least(five, hour), F.greatest(five, hour)
    low = F.least(F.col("rate_input"), F.when(F.col("cache_read").isNull(), F.col("rate_read")), F.when(F.col("cache_write").isNull(), low_w))
    high = F.greatest(F.col("rate_input"), F.when(F.col("cache_read").isNull(), F.col("rate_read")), F.when(F.col("cache_write").isNull(), high_w))
    speed = F.when(pace().isin("fast", "priority"), F.col("fast_multiplier")).when(pace() == "ultrafast", F.col("ultrafast_multiplier")).otherwise(F.lit(1).cast("decimal(8,4)"))
    factor = speed * F.when((F.col("geo") == "us") & (F.col("card_provider") == "anthropic"), F.lit("1.1").cast("decimal(4,2)")).otherwise(F.lit("1").cast("decimal(4,2)"))
    million = F.lit("0.000001").cast("decimal(6,6)")
    price = lambda w, i: (((fixed + rest_write * w + rest_in * i).cast("decimal(25,4)") * factor.cast("decimal(6,4)")).cast("decimal(31,8)") * million).cast(MONEY)
    return price(low_w, low), price(high_w, high)


def counted(requests: DataFrame, *only: str) -> DataFrame:
    """Requests that are equal but for the columns `only` (what no price depends on) as one row, with request_count: each kind is priced once."""
    return requests.groupBy(*[c for c in requests.columns if c not in only]).agg(F.count(F.lit(1)).alias("request_count"))


def priced(requests: DataFrame) -> DataFrame:
    """SCL-24: adds lower_cost, upper_cost and status: priced, range, or why not. Of provider, service_tier, reasoning (requests), card_provider and
    ultrafast_multiplier (card), what is not there is unknown. The surcharge of `us` is one provider's, and a place that is neither
    global nor `us` has no established rate with two of them."""
    low, high = cost()
    reason = (
        F.when(~F.col("known_model"), "unknown_model")
        .when(F.col("card_model").isNull(), "no_effective_rate")
        .when(F.col("input").isNull() | F.col("output").isNull(), "missing_usage")
        .when((F.coalesce("cache_read", F.lit(0)) + F.coalesce("cache_write", F.lit(0)) > F.col("input")) | F.coalesce(F.col("reasoning") > F.col("output"), F.lit(False)), "invalid_token_subsets")
        .when(F.col("provider").isNotNull() & (F.col("provider") != "") & ~route(F.col("provider")).eqNullSafe(F.col("card_provider")), "provider_model_mismatch")
        .when(pace().isin(*QUICK[:2]) & F.col("fast_multiplier").isNull() | (pace() == QUICK[2]) & F.col("ultrafast_multiplier").isNull(), "unknown_speed_rate")
        .when(~pace().isin(*PLAIN, *QUICK), "unsupported_service_tier")
        .when(F.col("geo").isNotNull() & ~F.col("geo").isin("global", "us") & F.col("card_provider").isin("anthropic", "openai"), "geography_rate_not_established")
        .when(F.coalesce("write_5m", F.lit(0)) + F.coalesce("write_1h", F.lit(0)) > F.coalesce("cache_write", F.lit(0)), "invalid_cache_ttl_split")
    )
    defaults = {"provider": "string", "service_tier": "string", "reasoning": "long", "card_provider": "string", "ultrafast_multiplier": "decimal(8,4)"}
    requests = requests.withColumns({c: F.lit(None).cast(t) for c, t in defaults.items() if c not in requests.columns})
    rows = requests.withColumn("reason", reason).withColumn("lower_cost", F.when(F.col("reason").isNull(), low)).withColumn("upper_cost", F.when(F.col("reason").isNull(), high))
    return rows.withColumn("status", F.coalesce("reason", F.when(F.col("lower_cost") == F.col("upper_cost"), "priced").otherwise("range"))).drop("reason")
