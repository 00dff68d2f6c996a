"""Ordered state as window functions: deltas of cumulative counters, fills, segments, islands, packed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cumulative_delta(rows: DataFrame, key: str, order: str, total: str, fresh: str | None = None) -> DataFrame:
    """WIN-01: increments of a cumulative counter. An equal snapshot gives none; a fall counts as a reset if the total equals the
    fresh usage of the row, and is excluded otherwise; either way it is the next row's baseline."""
    before = F.lag(total).over(Window.partitionBy(key).orderBy(order))
    reset = F.col(total) == F.col(fresh) if fresh else F.lit(True)
    rows = rows.withColumn("before", before)
    change = F.when(F.col("before").isNull(), F.col(total)).when(F.col(total) == F.col("before"), F.lit(None)).when(F.col(total) > F.col("before"), F.col(total) - F.col("before")).when(reset, F.col(total))
    kind = F.when(F.col("before").isNull(), "first").when(F.col(total) == F.col("before"), "same").when(F.col(total) > F.col("before"), "increment").when(reset, "reset").otherwise("excluded")
    return rows.withColumn("delta", change).withColumn("kind", kind).drop("before")


def rederived(rows: DataFrame, key: str, order: str, totals: list[str]) -> DataFrame:
    """WIN-02: the first row of each repeated endpoint, and its totals less those of the endpoint before."""
    first = Window.partitionBy(key, *totals).orderBy(order)
    rows = rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    w = Window.partitionBy(key).orderBy(order, *totals)
    return rows.withColumns({f"delta_{t}": F.col(t) - F.coalesce(F.lag(t).over(w), F.lit(0)) for t in totals})


def before_native(legacy: DataFrame, native: DataFrame, key: str, order: str, total: str, own: str) -> DataFrame:
    """WIN-03: legacy rows up to the total that the first native row started from; without any native row all of them."""
    first = native.groupBy(key).agg(F.min_by(F.struct((F.col(total) - F.col(own)).alias("budget")), order).alias("f")).select(key, F.col("f.budget").alias("budget"), F.lit(True).alias("has_native"))
    rows = legacy.join(first, key, "left")
    return rows.filter(F.col("has_native").isNull() | (F.col(total) <= F.col("budget"))).drop("has_native")


def agy_delta(rows: DataFrame, key: str, order: str, totals: list[str]) -> DataFrame:
    """WIN-04: differences of cumulative results; if any counter fell, the totals are the delta; the first is marked undated."""
    w = Window.partitionBy(key).orderBy(order)
    lags = {t: F.lag(t).over(w) for t in totals}
    fell = F.lit(False)
    for t, x in lags.items():
        fell = fell | F.coalesce(F.col(t) < x, F.lit(False))
    out = rows.withColumns({f"lag_{t}": x for t, x in lags.items()} | {"fell": fell, "undated": F.row_number().over(w) == 1})
    return out.withColumns({f"delta_{t}": F.when(F.col("fell"), F.col(t)).otherwise(F.col(t) - F.coalesce(F.col(f"lag_{t}"), F.lit(0))) for t in totals}).drop(*[f"lag_{t}" for t in totals], "fell")


def filled(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """WIN-06, JOIN-01: the value carried forward, and whether it was."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("filled", F.last(value, ignorenulls=True).over(w)).withColumn("inferred", F.col(value).isNull() & F.col("filled").isNotNull())


def segments(rows: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """WIN-07: the number of the segment, which rows where `starts` holds begin; and whether it is the key's last one."""
    w = Window.partitionBy(key)
    rows = rows.withColumn("segment", F.sum(starts.cast("int")).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("is_last", F.col("segment") == F.max("segment").over(w))


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """WIN-05: the first row of each key in an order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("nth = 1").drop("nth")


def union_length(intervals: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """WIN-17: length of the union of inclusive intervals: what each adds beyond the farthest end before it."""
    far = F.max(hi).over(Window.partitionBy(key).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col(hi) - F.greatest(F.col(lo), F.coalesce(far + 1, F.col(lo))) + 1)
    return intervals.withColumn("new", new).groupBy(key).agg(F.sum("new").alias("covered"), F.count(F.lit(1)).alias("n"))


def islands(rows: DataFrame, key: str, position: str) -> DataFrame:
    """WIN-18: maximal runs of consecutive positions."""
    mark = F.col(position) - F.row_number().over(Window.partitionBy(key).orderBy(position))
    return rows.withColumn("mark", mark).groupBy(key, "mark").agg(F.min(position).alias("lo"), F.max(position).alias("hi")).drop("mark")


def line_windows(rows: DataFrame, text: str, size: int = 60, step: int = 45) -> DataFrame:
    """WIN-16: windows of `size` lines every `step`, which stop at the end: first and last line (1-based) and their text."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    rows = rows.withColumn("lines", lines).withColumn("n", F.size("lines"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - (size - step)), F.lit(step))
    rows = rows.withColumn("first_line", F.explode(starts))
    last = F.least(F.col("first_line") + size - 1, F.col("n"))
    return rows.withColumn("last_line", last).withColumn("window", F.array_join(F.slice("lines", F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), "\n")).drop("lines", "n")


def greedy_lines(lines: Column, target: int) -> Column:
    """WIN-14: the number of the window of each line: a new one begins when the running size without white space would exceed the target."""
    empty = F.struct(F.array().cast("array<int>").alias("of"), F.lit(0).alias("size"), F.lit(0).alias("window"))

    def add(state: Column, line: Column) -> Column:
        n = F.length(F.regexp_replace(line, r"\s", ""))
        over = (state["size"] > 0) & (state["size"] + n > target)
        window = F.when(over, state["window"] + 1).otherwise(state["window"])
        return F.struct(F.array_append(state["of"], window).alias("of"), F.when(over, n).otherwise(state["size"] + n).alias("size"), window.alias("window"))

    return F.aggregate(lines, empty, add, lambda s: s["of"])


def breadcrumbs(headings: DataFrame, key: str, position: str, level: str, title: str, deepest: int = 6) -> DataFrame:
    """WIN-13: each heading with its ancestors, joined by ` > `: per level the last title, unless a higher heading came since."""
    w = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    rows = headings
    for k in range(1, deepest + 1):
        rows = rows.withColumn(f"at_{k}", F.max(F.when(F.col(level) == k, F.col(position))).over(w)).withColumn(f"title_{k}", F.last(F.when(F.col(level) == k, F.col(title)), ignorenulls=True).over(w))
    parts = []
    for k in range(1, deepest + 1):
        above = [F.coalesce(F.col(f"at_{j}"), F.lit(-1)) for j in range(1, k)]
        fresh = F.col(f"at_{k}") > F.greatest(*above, F.lit(-1), F.lit(-1))
        parts.append(F.when((F.col(level) >= k) & fresh, F.col(f"title_{k}")))
    return rows.withColumn("breadcrumb", F.concat_ws(" > ", *parts)).select(*headings.columns, "breadcrumb")
