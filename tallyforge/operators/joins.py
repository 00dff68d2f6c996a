"""Joins with fallback, wildcard, interval, replay and credit semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paired(calls: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """JOIN-02: calls and results in either order; what has no partner stays."""
    a, b = calls.withColumn("has_call", F.lit(True)), results.withColumn("has_result", F.lit(True))
    return a.join(b, key, "full_outer").withColumn("pairing", F.when(F.col("has_call").isNull(), "result_only").when(F.col("has_result").isNull(), "call_only").otherwise("both")).drop("has_call", "has_result")


def without_replay(child: DataFrame, parent: DataFrame, key: str, order: str, snapshot: list[str]) -> DataFrame:
    """JOIN-03: a child's leading run of snapshots that its parent has too is left out; from the first own one on all stay."""
    seen = parent.select(key, *snapshot).distinct().withColumn("seen", F.lit(1))
    rows = child.join(seen, [key, *snapshot], "left").withColumn("own", F.when(F.col("seen").isNull(), 1).otherwise(0))
    started = F.max("own").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("started", started).filter("started = 1").drop("seen", "own", "started")


def lineage(sessions: DataFrame, selected: Column, key: str, parent: str) -> DataFrame:
    """FLT-07, JOIN-06: selected sessions and those whose parent is selected."""
    chosen = sessions.filter(selected).select(F.col(key).alias(parent))
    return sessions.filter(selected).unionByName(sessions.filter(~selected).join(chosen, parent, "left_semi").select(sessions.columns))


def with_fallback(rows: DataFrame, mapping: DataFrame, key: str, parent: str, value: str, default: str) -> DataFrame:
    """JOIN-08: the map's value of the row's own key, else of its parent's, else a default."""
    own = mapping.select(F.col(key), F.col(value).alias("own_value"))
    up = mapping.select(F.col(key).alias(parent), F.col(value).alias("up_value"))
    return rows.join(own, key, "left").join(up, parent, "left").withColumn(value, F.coalesce("own_value", "up_value", F.lit(default))).drop("own_value", "up_value")


def with_wildcard(rows: DataFrame, mapping: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """JOIN-09: `group:key` wins over `group:*`."""
    exact = mapping.filter(F.col(key) != "*").select(group, key, F.col(value).alias("exact_value"))
    every = mapping.filter(F.col(key) == "*").select(group, F.col(value).alias("every_value"))
    return rows.join(exact, [group, key], "left").join(every, group, "left").withColumn(value, F.coalesce("exact_value", "every_value")).drop("exact_value", "every_value")


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """JOIN-15: pairs of inclusive intervals [a_lo, a_hi], [b_lo, b_hi] of a key that overlap. Intervals are dealt into cells of
    `width`, so that the join is an equi-join; a pair counts in the cell where its overlap starts."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    x, y = a.withColumn("cell", cells("a_lo", "a_hi")), b.withColumn("cell", cells("b_lo", "b_hi"))
    starts = F.floor(F.greatest("a_lo", "b_lo") / width)
    return x.join(y, [key, "cell"]).filter((F.col("a_lo") <= F.col("b_hi")) & (F.col("a_hi") >= F.col("b_lo")) & (F.col("cell") == starts)).drop("cell")


def credited(before: DataFrame, after: DataFrame, key: str, member: str) -> DataFrame:
    """JOIN-17, JOIN-22: multiset matching: the n-th row of a key on one side meets the n-th on the other, once each; the rest are added or gone."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(member))
    a = before.select(key, F.col(member).alias("old_member"), number.alias("nth"))
    b = after.select(key, F.col(member).alias("new_member"), number.alias("nth"))
    both = a.join(b, [key, "nth"], "full_outer")
    return both.withColumn("status", F.when(F.col("old_member").isNull(), "added").when(F.col("new_member").isNull(), "departed").when(F.col("old_member") == F.col("new_member"), "kept").otherwise("moved"))
