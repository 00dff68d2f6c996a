"""Repository-map ranking: weighted reference edges, personalised PageRank, definition scores (AGG-31 to AGG-33, JOIN-16).

PageRank is a loop of joins over edges; each round's ranks are a written table in the folder that the cluster shares, so that the plan stays short
and a lost executor costs a re-read. The edges are written once.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAMPING, ROUNDS = 0.85, 100


def _kept(df: DataFrame) -> DataFrame:
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _gone(df: DataFrame) -> None:
    """Deletes a table of _kept() that nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def naming_factor(ident: Column, definers: Column, symbols: list[str] = ()) -> Column:
    """SCL-21: ten times for a named symbol; ten times for snake, kebab and camel case of eight characters or more; a tenth for a leading
    underscore, and for more than five definers."""
    letters, upper, lower = ident.rlike(r"\p{L}"), ident.rlike(r"\p{Lu}"), ident.rlike(r"\p{Ll}")
    styled = ((ident.contains("_") | ident.contains("-")) & letters) | (upper & lower)
    times = lambda hit, by: F.when(hit, by).otherwise(1.0)
    return times(ident.isin(*symbols), 10.0) * times(styled & (F.length(ident) >= 8), 10.0) * times(ident.startswith("_"), 0.1) * times(definers > 5, 0.1)


def reference_edges(definitions: DataFrame, references: DataFrame, symbols: list[str] = (), focus: list[str] = ()) -> DataFrame:
    """JOIN-16, AGG-32: src refers to ident, which dst defines: sqrt(references) x naming_factor, fifty times from a focus file; a definition without
    references points weakly at itself. Where nothing refers to anything, definitions count as references."""
    if references.isEmpty():
        references = definitions
    n = references.groupBy("path", "ident").agg(F.count(F.lit(1)).alias("n"))
    own = definitions.select(F.col("path").alias("dst"), "ident").distinct()
    own = own.join(own.groupBy("ident").agg(F.count(F.lit(1)).alias("definers")), "ident")
    weight = F.sqrt("n") * naming_factor(F.col("ident"), F.col("definers"), symbols) * F.when(F.col("src").isin(*focus), 50.0).otherwise(1.0)
    edges = n.withColumnRenamed("path", "src").join(own, "ident").select("src", "dst", "ident", weight.alias("weight"))
    alone = own.join(n.select("ident").distinct(), "ident", "left_anti").select(F.col("dst").alias("src"), "dst", "ident", F.lit(0.1).alias("weight"))
    return edges.unionByName(alone)


def pagerank(nodes: DataFrame, edges: DataFrame, preference: DataFrame | None = None, rounds: int = ROUNDS, tolerance: float | None = 1e-6) -> DataFrame:
    """node, rank. nodes: node; edges: src, dst, weight; preference: node, pref (of any sum; uniform by default, or where it adds up to nothing). A
    dangling node's rank goes to the preference. Ends when the change is below tolerance x nodes; ranks that have not come to rest after
    `rounds` are uniform. With tolerance None exactly `rounds` are run. Four rounds make one written table and one job."""
    total = nodes.count()
    even = F.lit(1.0 / max(total, 1))
    base = nodes.select("node", even.alias("pref"))
    if preference is not None:
        given = nodes.select("node").join(preference.groupBy("node").agg(F.sum("pref").alias("pref")), "node", "left").withColumn("pref", F.coalesce("pref", F.lit(0.0)))
        whole = given.agg(F.sum("pref")).first()[0]
        base = given.withColumn("pref", F.col("pref") / F.lit(whole)) if whole else base
    out = edges.groupBy("src").agg(F.sum("weight").alias("out")).filter("out > 0")
    share = _kept(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("w")))
    base = _kept(base.join(out.select(F.col("src").alias("node"), F.lit(True).alias("leads")), "node", "left").select("node", "pref", F.col("leads").isNull().alias("dangling")))
    rank, step, held = base.select("node", "pref", "dangling", even.alias("rank")), 4, None
    done = 0
    while done < rounds:
        for _ in range(min(step, rounds - done)):
            lost = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
            came = share.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("came"))
            after = (DAMPING * F.coalesce("came", F.lit(0.0)) + (DAMPING * F.col("lost") + 1 - DAMPING) * F.col("pref")).alias("rank")
            rank = rank.withColumnRenamed("rank", "was").join(came, "node", "left").crossJoin(F.broadcast(lost)).select("node", "pref", "dangling", after, "was")  # lost is one row
            last, rank = rank, rank.drop("was")
            done += 1
        last = _kept(last)
        if held is not None:
            _gone(held)
        held, rank = last, last.drop("was")
        if tolerance is not None and last.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < tolerance * total:
            return rank.select("node", "rank")
    return rank.select("node", "rank") if tolerance is None or not total else nodes.select("node", even.alias("rank"))


def definition_scores(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """AGG-33: a file's rank flows over its edges; what arrives at (dst, ident) adds up."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    flow = edges.join(out, "src").join(rank.withColumnRenamed("node", "src"), "src")
    return flow.groupBy("dst", "ident").agg(F.sum(F.col("rank") * F.col("weight") / F.col("out")).alias("score"))


def ordered_definitions(definitions: DataFrame, scores: DataFrame, symbols: list[str] = (), focus: list[str] = ()) -> DataFrame:
    """WIN-19, SET-07: definitions (path, ident, line) in the order of a map: named symbols first, then focus files, then by score, largest first, path,
    identifier and line; what has no score comes last, by path and line. The order's columns are kept."""
    best = scores.select(F.col("dst").alias("path"), "ident", "score")
    rows = definitions.select("path", "ident", "line").distinct().join(best, ["path", "ident"], "left")
    rows = rows.withColumns({"named": F.col("ident").isin(*symbols), "focused": F.col("path").isin(*focus)})
    return rows.orderBy(F.desc("named"), F.desc("focused"), F.col("score").desc_nulls_last(), "path", F.when(F.col("score").isNotNull(), F.col("ident")), "line", "ident")


def coverage_cap(ranked: DataFrame, percent: float, *order: Column | str) -> DataFrame:
    """SORT-11: the first ceil(percent) of the ranked rows, at least one."""
    found = ranked.count()
    return ranked.orderBy(*order).limit(min(found, max(1, math.ceil(found * percent / 100))))


def line_map(rows: DataFrame, key: str, budget: int, most: int = 240) -> DataFrame:
    """SORT-10: rows (key, path, line, snippet, in order of place) as `path:Lline: snippet`, a snippet cut to `most` characters, up to the first
    that no longer fits into the budget of characters, line ends included."""
    shown = F.concat(F.col("path"), F.lit(":L"), F.col("line").cast("string"), F.lit(": "), F.substring("snippet", 1, most))
    upto = F.sum(F.length("shown") + 1).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("shown", shown).withColumn("upto", upto).filter(F.col("upto") <= budget)
