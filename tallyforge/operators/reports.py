"""Reports and lookups over indexed tables: pseudonyms, citations, symbols, coverage, resolution, verification, rendering."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.scalars import words


def pseudonymised(rows: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """FLT-12: identifiers become digests that agree within one report; null stays null."""
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.concat(F.lit("item-"), F.substring(F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256), 1, 10))) for c in columns})


def cited(citations: DataFrame, files: DataFrame) -> DataFrame:
    """FLT-23: citations (path, sha256, start_line, end_line, quote) against files (path, sha256, text): what holds, or why not."""
    f = files.select("path", F.col("sha256").alias("now"), F.split("text", "\n").alias("lines"), F.lit(True).alias("there"))
    rows = citations.join(f, "path", "left")
    part = F.array_join(F.slice("lines", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    verdict = F.when(F.col("there").isNull(), "missing_file").when(F.col("sha256") != F.col("now"), "stale").when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.size("lines")), "bad_range")
    return rows.withColumn("verdict", verdict.when(~F.contains(part, F.col("quote")), "quote_not_found").otherwise("ok")).drop("now", "lines", "there")


def symbol_matches(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """JOIN-13, SCL-16: names (question, name) and symbols (unit, symbol) meet on the folded leaf name: 4 same text, 3 same but for case, 2 the leaf alone, 1 the folded leaf."""
    leaf = lambda c: F.element_at(F.split(c, r"\."), -1)
    a = names.withColumn("fold", F.lower(leaf(F.col("name"))))
    b = symbols.withColumn("fold", F.lower(leaf(F.col("symbol"))))
    level = F.when(F.col("name") == F.col("symbol"), 4).when(F.lower("name") == F.lower("symbol"), 3).when(leaf(F.col("name")) == leaf(F.col("symbol")), 2).otherwise(1)
    return a.join(b, "fold").withColumn("level", level).drop("fold")


def covered(units: DataFrame, vectors: DataFrame, group: str, key: str) -> DataFrame:
    """JOIN-12, AGG-28: units and those with a vector, by group."""
    return units.join(vectors.select(key, F.lit(1).alias("has")).dropDuplicates([key]), key, "left").groupBy(group).agg(F.count(F.lit(1)).alias("units"), F.count("has").alias("embedded"))


def resolved(libraries: DataFrame, name: str, question: str, limit: int = 10) -> DataFrame:
    """SORT-14: libraries (id, title) by 100 for the exact name and one for each distinct question word in the title, then by id."""
    terms = F.array_distinct(words(F.lit(question)))
    score = F.when(F.lower("title") == name.lower(), 100).otherwise(0) + F.size(F.array_intersect(words(F.col("title")), terms))
    return libraries.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def verified(results: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """STR-04: results (with the hash they were indexed by) against current hashes: fresh, stale or withheld."""
    now = current.select(key, F.col("sha256").alias("now"), F.lit(True).alias("there"))
    return results.join(now, key, "left").withColumn("state", F.when(F.col("there").isNull(), "withheld").when(F.col("sha256") == F.col("now"), "fresh").otherwise("stale")).drop("now", "there")


def bridged(docs: DataFrame, symbols: DataFrame, names: int = 6, each: int = 3) -> DataFrame:
    """JOIN-14: names in backticks of ranked documents (question, place, text) to units of symbols (name, unit), bounded for each question and name."""
    found = docs.select("question", "place", F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"`([A-Za-z_][\w.]*)`"), 1))).alias("nth", "name"))
    first = found.groupBy("question", "name").agg(F.min(F.struct("place", "nth")).alias("at"))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("question").orderBy("at", "name"))).filter(F.col("k") <= names)
    out = first.join(symbols, "name").withColumn("n", F.row_number().over(Window.partitionBy("question", "name").orderBy("unit"))).filter(F.col("n") <= each)
    return out.select("question", "name", "unit", F.col("at.place").alias("place"))


def escaped(x: Column) -> Column:
    """SCL-30: safe in a Markdown table."""
    return F.regexp_replace(F.regexp_replace(x, r"([\\`*_{}\[\]<>|])", r"\\$1"), r"[\r\n]+", " ")


def markdown(rows: DataFrame, title: str, order: list[Column], limit: int = 50) -> str:
    """SNK-04, SORT-05: a table of the first rows of a small aggregate."""
    top = rows.orderBy(*order).limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in top)]) + "\n"


def rate_card(spark: SparkSession, card: str | dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-16: rates, tiers and aliases of a JSON rate card (a path or a parsed one), which is refused where it is inconsistent."""
    data = card if isinstance(card, dict) else json.loads(Path(card).read_text())
    rates, tiers = [], []
    names = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")
    for model, variants in data["models"].items():
        for number, v in enumerate(variants if isinstance(variants, list) else [variants]):
            if any(not isinstance(v.get(n, 0), int | float) or isinstance(v.get(n, 0), bool) or v.get(n, 0) < 0 for n in names):
                raise ValueError(f"{model}: rates must be numbers, zero at least")
            if v.get("effective_from") and v.get("effective_until") and v["effective_from"] >= v["effective_until"]:
                raise ValueError(f"{model}: it ends before it starts")
            rates.append((model, number, v.get("effective_from"), v.get("effective_until"), *(str(v.get(n, 0) or (v.get("input", 0) if n.startswith("cache_write") else 0)) for n in names), str(v["fast_multiplier"]) if "fast_multiplier" in v else None))
            tiers += [(model, number, k, t["above"], str(t["input"]), str(t["output"])) for k, t in enumerate(v.get("tiers", []))]
    lost = {a: t for a, t in data.get("aliases", {}).items() if t not in data["models"]}
    if lost:
        raise ValueError(f"aliases of unknown models: {lost}")
    money = [F.col(c).cast("decimal(10,4)").alias(c) for c in ("rate_input", "rate_output", "rate_read", "rate_5m", "rate_1h")]
    r = spark.createDataFrame(rates, "model string, variant int, effective_from string, effective_until string, rate_input string, rate_output string, rate_read string, rate_5m string, rate_1h string, fast_multiplier string")
    r = r.select("model", "variant", F.col("effective_from").cast("timestamp_ntz").alias("effective_from"), F.col("effective_until").cast("timestamp_ntz").alias("effective_until"), *money, F.col("fast_multiplier").cast("decimal(8,4)").alias("fast_multiplier"))
    t = spark.createDataFrame(tiers, "model string, variant int, tier_no int, above long, tier_input string, tier_output string").withColumns({c: F.col(c).cast("decimal(20,6)") for c in ("tier_input", "tier_output")})
    return r, t, spark.createDataFrame(list(data.get("aliases", {}).items()), "alias string, target string")


def canonical(fields: dict[str, Column]) -> Column:
    """SCL-12: compact JSON with sorted keys; nulls and non-ASCII stay."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def wire(rows: DataFrame, body: str) -> DataFrame:
    """SNK-10: rows with the characters of their serialised body and the tokens that they are estimated at."""
    return rows.withColumns({"characters": F.length(body).cast("long"), "tokens": F.ceil(F.length(body) / 4).cast("long")})


def written(frames: dict[str, DataFrame], path: str, formats: tuple[str, ...] = ("json",)) -> dict[str, str]:
    """SNK-01, SNK-02, SNK-08: each part of a report as JSON lines (or Parquet) under the path, all of them planned before the first is written; a
    part is whole once its folder has _SUCCESS. Returns the paths."""
    for df in frames.values():
        df.schema  # noqa: B018  fails before anything is written
    out = {}
    for kind in formats:
        for name, df in frames.items():
            out[f"{name}.{kind}"] = f"{path}/{kind}/{name}"
            df.write.format(kind).mode("errorifexists").save(out[f"{name}.{kind}"])
    return out


def consistent(found: DataFrame, selected: DataFrame, key: str, percent: float) -> DataFrame:
    """SNK-09, JOIN-23: one row: what was found and selected, the cap that the percentage allows, and whether the selection keeps to
    it, repeats nothing and holds nothing that was not found."""
    n = found.agg(F.count(F.lit(1)).alias("found"))
    chosen = selected.agg(F.count(F.lit(1)).alias("selected"), F.count_distinct(key).alias("distinct_selected"))
    strange = selected.join(found.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    rows = n.crossJoin(chosen).crossJoin(strange)  # one row each
    cap = F.least("found", F.greatest(F.lit(1), F.ceil(F.col("found") * percent / 100)))
    return rows.withColumn("cap", cap.cast("long")).withColumn("sound", (F.col("selected") <= F.col("cap")) & (F.col("selected") == F.col("distinct_selected")) & (F.col("strangers") == 0))
