"""Snapshots: incremental refresh, freshness audit, member comparison, fingerprints, ledger upsert, page summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.operators.graph import _gone, _kept


def refreshed(indexed: DataFrame, listed: DataFrame, key: str, stamp: str, content: str) -> DataFrame:
    """STR-01, JOIN-18: what an incremental refresh does with each key: add, change, metadata, keep or delete. The content hash
    only counts where the stamp differs."""
    a = indexed.select(key, F.col(stamp).alias("old_stamp"), F.col(content).alias("old_content"), F.lit(True).alias("was"))
    b = listed.select(key, F.col(stamp).alias("new_stamp"), F.col(content).alias("new_content"), F.lit(True).alias("now"))
    action = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "delete").when(F.col("old_stamp").eqNullSafe(F.col("new_stamp")), "keep").when(F.col("old_content").eqNullSafe(F.col("new_content")), "metadata").otherwise("change")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def audited(indexed: DataFrame, listed: DataFrame) -> DataFrame:
    """STR-03, SET-05: rows on one side only; none means fresh."""
    return indexed.exceptAll(listed).withColumn("side", F.lit("index")).unionByName(listed.exceptAll(indexed).withColumn("side", F.lit("disk")))


def fingerprint(rows: DataFrame, group: str, path: str, content: Column) -> DataFrame:
    """AGG-30: SHA-256 over a group's path and content hash lines in order of path."""
    lines = F.array_sort(F.collect_list(F.concat_ws("\t", F.col(path).cast("string"), F.sha2(content, 256))))
    return rows.groupBy(group).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def upserted(ledger: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """STR-07, SNK-06: of old and new rows of a key the last in order stays."""
    both = ledger.unionByName(new, allowMissingColumns=True)
    return both.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last(order)))).filter("nth = 1").drop("nth")


#: Parts into which a form's values are dealt at once (a power of two), and forms that are broadcast.
PARTS, FORMS = 4096, 100_000


def _small(forms: DataFrame) -> DataFrame:
    return F.broadcast(forms) if len(forms.take(FORMS + 1)) <= FORMS else forms


def _middles(values: DataFrame, spans: DataFrame) -> DataFrame:
    """form, low, high: the two middle values (one twice where their number is odd). values: form, x; spans: form, lo, hi, n.

    The values between lo and hi are counted in equal parts, the part that holds the lower middle one is the next span, until its values are
    equal: a few scans that sort and shuffle no values, and at most PARTS counts a form.
    """
    state = _kept(spans.filter("n > 0").select("form", "lo", "hi", "n", F.lit(0).cast("long").alias("before"), F.col("lo").alias("above"), F.col("n").alias("here")))
    order = Window.partitionBy("form").orderBy("part")
    while not (wide := state.filter("lo < hi")).isEmpty():
        open_ = _small(wide)
        width = F.col("hi") / PARTS - F.col("lo") / PARTS
        even = F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(PARTS - 1).cast("long"))
        ends = F.when(F.col("x") == F.col("lo"), 0).when(F.col("x") == F.col("hi"), 2).otherwise(1).cast("long")  # infinite, not a number, or too near
        finite = (F.col("lo") > float("-inf")) & (F.col("hi") < float("inf")) & (width > 0)
        rows = values.join(open_, "form").filter("x >= lo AND x <= hi").select("form", "x", F.when(finite, even).otherwise(ends).alias("part"))
        parts = rows.groupBy("form", "part").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("b")).join(open_, "form")
        parts = parts.withColumn("upto", F.col("before") + F.sum("c").over(order)).withColumn("above", F.coalesce(F.lead("a").over(order), "above"))
        middle = F.expr("(n - 1) div 2")
        new = parts.filter((F.col("upto") > middle) & (F.col("upto") - F.col("c") <= middle)).select("form", F.col("a").alias("lo"), F.col("b").alias("hi"), "n", (F.col("upto") - F.col("c")).alias("before"), "above", F.col("c").alias("here"))
        old, state = state, _kept(new.unionByName(state.filter("lo = hi")))
        _gone(old)
    return state.select("form", F.col("lo").alias("low"), F.when(F.expr("n div 2 < before + here"), F.col("lo")).otherwise(F.col("above")).alias("high"))


def run_summary(runs: DataFrame, form: str, run: str, measure: str) -> DataFrame:
    """AGG-20, SORT-12: true median, least and most of the runs, and the run nearest to the median, the first of equals."""
    rows = runs.select(F.col(form).alias("form"), F.col(run).alias("run"), F.col(measure).alias("m"), F.col(measure).cast("double").alias("x")).filter("form IS NOT NULL")
    spans = _kept(rows.groupBy("form").agg(F.min("m").alias("least"), F.max("m").alias("most"), F.count("m").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    median = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * 0.5 + F.col("high") * 0.5)
    middle = spans.join(_middles(rows.select("form", "x"), spans), "form", "left").withColumn("median", median)
    # no value lies between the middle ones, so that one of them is the nearest
    middle = middle.withColumn("far", F.least(F.abs(F.col("low") - F.col("median")), F.abs(F.col("high") - F.col("median"))))
    middle = _kept(middle.select("form", "median", "least", "most", "n", "far"))
    near = rows.join(_small(middle.select("form", "median", "far")), "form").filter("median IS NULL OR abs(x - median) <= far").groupBy("form").agg(F.min("run").alias("representative"))
    return middle.drop("far").join(near, "form").withColumnRenamed("form", form)


def payload(requests: DataFrame, key: Column | str, size: str, first_party: Column) -> DataFrame:
    """AGG-21, AGG-42: requests, bytes and third-party bytes by type or host."""
    return requests.groupBy(key).agg(F.count(F.lit(1)).alias("requests"), F.sum(size).alias("bytes"), F.sum(F.when(first_party, 0).otherwise(F.col(size))).alias("third_party_bytes"))
