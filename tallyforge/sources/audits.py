"""Reports of page audits: `<form>-<n>.report.json` files of a folder, their metrics, scores, failing audits and requests (SRC-26, FLT-21, FLT-22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalars import site_key

#: What the metrics are called in reports.
METRICS = {
    "FCP": "first-contentful-paint",
    "LCP": "largest-contentful-paint",
    "TBT": "total-blocking-time",
    "CLS": "cumulative-layout-shift",
    "SI": "speed-index",
    "TTFB": "server-response-time",
}
AUDIT = "struct<id: string, title: string, score: double, scoreDisplayMode: string, numericValue: double, displayValue: string>"
REPORT = f"finalDisplayedUrl string, finalUrl string, requestedUrl string, lighthouseVersion string, entities array<struct<name: string, isFirstParty: boolean>>, categories map<string, struct<score: double, auditRefs: array<struct<id: string>>>>, audits map<string, {AUDIT}>"
REQUEST = "array<struct<url: string, resourceType: string, transferSize: double, resourceSize: double, entity: string>>"


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-26: form (mobile or desktop), run (the file's name), report and requests, a row a file; other files are left out."""
    files = spark.read.option("pathGlobFilter", "*.report.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("run"), "value")
    items = F.get_json_object("value", "$.audits['network-requests'].details.items")
    form = F.regexp_extract("run", r"^(mobile|desktop)-", 1)
    return files.select(form.alias("form"), "run", F.from_json("value", REPORT).alias("report"), F.from_json(items, REQUEST).alias("requests")).filter("form != ''")


def metrics(rows: DataFrame) -> DataFrame:
    """form, run, metric, value (null where a report has none)."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.try_element_at("report.audits", F.lit(i))["numericValue"].alias("value")) for k, i in METRICS.items()])
    return rows.select("form", "run", F.inline(each))


def scores(rows: DataFrame) -> DataFrame:
    """form, run, category, score: of a hundred; a missing score is 0."""
    return rows.select("form", "run", F.explode("report.categories").alias("category", "c")).select("form", "run", "category", F.floor(F.coalesce("c.score", F.lit(0.0)) * 100 + 0.5).alias("score"))


def failing(rows: DataFrame) -> DataFrame:
    """FLT-21: form, run, category, position, id, title, score. Performance: below 0.9, neither informative nor a metric; the other
    categories: binary or numeric ones below 1."""
    refs = rows.select("form", "run", "report", F.explode("report.categories").alias("category", "c")).select("form", "run", "report", "category", F.posexplode("c.auditRefs.id").alias("position", "ref"))
    own = refs.select("form", "run", "category", "position", F.try_element_at("report.audits", F.col("ref")).alias("a")).filter("a.score IS NOT NULL")
    mode = F.coalesce("a.scoreDisplayMode", F.lit(""))
    slow = (F.col("category") == "performance") & (F.col("a.score") < 0.9) & (mode != "informative") & ~F.col("a.id").isin(*METRICS.values())
    other = F.col("category").isin("accessibility", "best-practices", "seo") & (F.col("a.score") < 1) & mode.isin("binary", "numeric")
    return own.filter(slow | other).select("form", "run", "category", "position", "a.id", "a.title", "a.score")


def requests(rows: DataFrame) -> DataFrame:
    """FLT-22: form, run, type, host, bytes, first_party: by the page's own entities where the report and the request name them, else by site."""
    host = lambda url: F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("other")))
    site = lambda url: F.coalesce(site_key(url), F.lit("other"))
    page = F.coalesce(*[F.when(F.col(f"report.{c}") != "", F.col(f"report.{c}")) for c in ("finalDisplayedUrl", "finalUrl", "requestedUrl")])
    own = F.transform(F.filter(F.coalesce("report.entities", F.array().cast("array<struct<name: string, isFirstParty: boolean>>")), lambda e: F.coalesce(e["isFirstParty"], F.lit(False))), lambda e: e["name"])
    each = rows.select("form", "run", page.alias("page"), own.alias("own"), F.explode("requests").alias("r"))
    named = (F.size("own") > 0) & (F.coalesce("r.entity", F.lit("")) != "")
    first = F.when(named, F.array_contains("own", F.col("r.entity"))).otherwise(site(F.col("r.url")) == site(F.col("page")))
    return each.select("form", "run", F.coalesce("r.resourceType", F.lit("Other")).alias("type"), host(F.col("r.url")).alias("host"), F.coalesce("r.transferSize", F.lit(0.0)).alias("bytes"), first.alias("first_party"))
