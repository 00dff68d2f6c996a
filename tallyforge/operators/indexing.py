"""The index as tables: generations, refresh with one retry, a cache by content, lookups and counters (AGG-26, AGG-27, JOIN-07, JOIN-21, SNK-07, STR-05,
STR-06, STR-10, WIN-20, FLT-26)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.joins import overlaps

#: What a query may ask for.
MODES, REFRESH, KINDS = ("lexical", "semantic", "hybrid"), ("auto", "off", "strict"), (None, "code", "docs")


def checked_query(question: str, mode: str = "lexical", limit: int = 5, refresh: str = "auto", kind: str | None = None, tokens: int | None = None) -> None:
    """FLT-26: raises ValueError for arguments that no query has."""
    if not isinstance(question, str) or not question.strip() or len(question) > 8000:
        raise ValueError("a question has 1 to 8000 characters")
    if mode not in MODES or refresh not in REFRESH or kind not in KINDS or not 1 <= limit <= 50:
        raise ValueError("unknown mode, refresh policy or kind, or a limit outside of 1 to 50")
    if tokens is not None and not 256 <= tokens <= 32_000:
        raise ValueError("a token budget lies within 256 and 32000")


def published(rows: DataFrame, path: str, *partitions: str) -> int:
    """SNK-07, STR-06: writes rows as the next generation below path and returns its number; readers of earlier generations are not disturbed, and
    a generation counts once its committer has ended."""
    number = (newest_generation(rows.sparkSession, path) or 0) + 1
    rows.write.partitionBy(*partitions).parquet(f"{path}/generation={number}") if partitions else rows.write.parquet(f"{path}/generation={number}")
    return number


def newest_generation(spark: SparkSession, path: str) -> int | None:
    """The largest generation that is whole."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory()]
    whole = [n for n in names if n.startswith("generation=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max((int(n.split("=")[1]) for n in whole), default=None)


def snapshot(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """STR-06: the rows of one generation, the newest by default, whatever is written meanwhile."""
    number = generation or newest_generation(spark, path)
    if number is None:
        raise ValueError(f"no generation in {path}")
    return spark.read.parquet(f"{path}/generation={number}")


def with_refresh(answer: Callable[[], DataFrame], stale: Callable[[DataFrame], int], refresh: Callable[[], None], policy: str = "auto", most: int = 10) -> DataFrame:
    """STR-05: an answer, and where it rests on one to `most` changed files and the policy is auto, a refresh and one more answer, which stands."""
    first = answer()
    if policy != "auto" or not 0 < stale(first) <= most:
        return first
    refresh()
    return answer()


def cached(rows: DataFrame, cache: DataFrame | None, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """STR-10: compute's results (which keep the key) for rows, from the cache where it has the key, and the new ones alone, to be added to it."""
    if cache is None:
        fresh = compute(rows)
        return fresh, fresh
    fresh = compute(rows.join(cache.select(key), key, "left_anti"))
    return cache.join(rows.select(key), key, "left_semi").unionByName(fresh), fresh


def touched(warnings: DataFrame, sources: DataFrame, selected: Column) -> DataFrame:
    """JOIN-07: warnings whose source has a selected row."""
    return warnings.join(sources.filter(selected).select("source_id").distinct(), "source_id", "left_semi")


def looked_up(rows: DataFrame, *order: Column | str, **values: object) -> DataFrame:
    """JOIN-21: the one row with these values, the first in order."""
    for name, value in values.items():
        rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
    return rows.orderBy(*order).limit(1)


def inventory_summary(files: DataFrame, path: str = "path", language: str = "language") -> DataFrame:
    """AGG-26: files by language, and by the first two folders of the path: group, label, files."""
    parts = F.split(path, "/")
    module = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(2))), "/")).otherwise(".")
    both = F.explode(F.array(F.struct(F.lit("language").alias("group"), F.coalesce(language, F.lit("unknown")).alias("label")), F.struct(F.lit("module").alias("group"), module.alias("label"))))
    return files.select(both.alias("g")).groupBy("g.group", "g.label").agg(F.count(F.lit(1)).alias("files"))


def index_counters(units: DataFrame, *labels: str) -> DataFrame:
    """AGG-27: units, redacted and oversized ones, by each label alone and in all: kind, label, units, redacted, oversized."""
    each = F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("label")), *[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("label")) for c in labels]))
    return units.select(each.alias("g"), "redacted", "oversized").groupBy("g.kind", "g.label").agg(F.count(F.lit(1)).alias("units"), F.count_if("redacted").alias("redacted"), F.count_if("oversized").alias("oversized"))


def enclosing(points: DataFrame, spans: DataFrame, key: str, width: int) -> DataFrame:
    """WIN-20: for each point (key, point, at) the innermost span (key, span, lo, hi, both inclusive): the shortest, then the latest start, then the name."""
    a = points.select(key, "point", F.col("at").alias("a_lo"), F.col("at").alias("a_hi"))
    b = spans.select(key, "span", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    best = F.min(F.struct((F.col("b_hi") - F.col("b_lo")).alias("size"), (-F.col("b_lo")).alias("late"), "span"))
    return overlaps(a, b, key, width).groupBy(key, "point").agg(best.alias("best")).select(key, "point", F.col("best.span").alias("span"))


def exact_sum(x: Column) -> Column:
    """AGG-35: a sum that does not depend on the rows' order, as a compensated one does not: whole decimals are added."""
    return F.sum(x.cast("decimal(28,10)")).cast("double")
