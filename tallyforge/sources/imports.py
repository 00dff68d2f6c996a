"""Datasets that come ready-made: imports of the normalised schema, snapshots of quotas, a synthetic demo, discovery and collection
(SRC-10 to SRC-13, SRC-15). A wrong import fails as a whole; unknown fields are dropped, since only the listed ones are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalars import digest, guarded, instant, safe_name
from tallyforge.sources import logs

COUNTS = ["input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens", "request_count"]


def demo(spark: SparkSession, days: int = 14) -> DataFrame:
    """SRC-15: agents' usage by rule: agent, session_id, ts, input_tokens, cache_read_tokens, output_tokens."""
    agents = F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(k).alias("k")) for k, a in enumerate(("codex", "claude", "grok"), 1)]))
    rows = spark.range(days).select(F.col("id").alias("i"), agents.alias("a")).select("i", "a.agent", "a.k")
    start = F.lit("2026-01-01 09:00:00").cast("timestamp_ntz")
    inputs = (1000 * F.col("k") + 37 * F.col("i")).cast("long")
    session = F.concat(F.lit("demo-"), "agent", F.lit("-"), F.floor(F.col("i") / 2).cast("string"))
    return rows.select("agent", session.alias("session_id"), (start + F.make_dt_interval(F.col("i").cast("int"), F.col("k"))).alias("ts"), inputs.alias("input_tokens"), F.floor(inputs / 2).cast("long").alias("cache_read_tokens"), (100 * F.col("k") + 11 * F.col("i")).cast("long").alias("output_tokens"))


def _or_fail(ok: Column, value: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def imported(datasets: DataFrame) -> DataFrame:
    """SRC-12: usage rows of normalised datasets (value: a JSON object with schema_version 1 and a list `usage`). Instants need an offset, counts must
    be finite and not negative, agent and session are required; a missing request count is one; a missing id follows from the row."""
    fields = {"id": "string", "agent": "string", "session_id": "string", "model": "string", "timestamp": "string", "account": "string"} | dict.fromkeys(COUNTS, "string")
    version = F.get_json_object("value", "$.schema_version")
    checked = datasets.select(_or_fail(version == "1", F.col("value"), "an import needs schema_version 1").alias("value"))
    rows = checked.select(F.explode(F.from_json(F.get_json_object("value", "$.usage"), "array<struct<" + ",".join(f"`{k}`:{t}" for k, t in fields.items()) + ">>")).alias("r")).select("r.*")
    at = instant(F.col("timestamp"))
    rows = rows.withColumn("ts", F.when(F.col("timestamp").isNull(), at).otherwise(_or_fail(at.isNotNull(), at, "an instant has no offset or is none")))
    for c in COUNTS:
        n = guarded(F.col(c).try_cast("double"))
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(_or_fail(n.isNotNull(), n, "a count is not finite or is negative")))
    for c in ("agent", "session_id"):
        rows = rows.withColumn(c, _or_fail(F.col(c).isNotNull() & (F.col(c) != ""), safe_name(F.col(c)), "usage needs an agent and a session"))
    rows = rows.withColumns({"request_count": F.coalesce("request_count", F.lit(1.0)), "model": safe_name(F.col("model"))})
    own = digest(F.lit("usage"), *[F.col(c).cast("string") for c in ("agent", "session_id", "model", "ts", *COUNTS)])
    return rows.select(F.coalesce("id", own).alias("id"), "agent", "session_id", "model", "ts", "account", *[F.col(c).cast("long").alias(c) for c in COUNTS])


def quota_snapshot(raw: DataFrame) -> DataFrame:
    """SRC-13: quota rows of native exports (agent, account, observed_at, value: a JSON object): bucket, window_minutes, resets_at, used_percent. What
    remains as a fraction becomes used percent; over 100 or unknown percentages give no row."""
    of = lambda path: F.get_json_object("value", path)
    maps = F.coalesce(F.from_json(of("$.rate_limits"), "map<string,string>"), F.from_json(of("$.quota"), "map<string,string>"))
    limits = F.coalesce(F.from_json(of("$.rateLimitsByLimitId"), "map<string,string>"), F.create_map(F.lit("codex"), F.coalesce(of("$.rateLimits"), F.col("value"))))
    others = raw.filter("agent <> 'codex'").select("*", F.explode(maps).alias("bucket", "q"))
    codex = raw.filter("agent = 'codex'").select("*", F.explode(limits).alias("limit", "both")).select("*", F.explode(F.array(F.lit("primary"), F.lit("secondary"))).alias("part"))
    codex = codex.select(*raw.columns, F.concat_ws(":", "limit", "part").alias("bucket"), F.when(F.col("part") == "primary", F.get_json_object("both", "$.primary")).otherwise(F.get_json_object("both", "$.secondary")).alias("q"))
    rows = others.unionByName(codex).filter(F.col("q").isNotNull() & F.col("q").startswith("{"))
    at = lambda *names: F.coalesce(*[F.get_json_object("q", f"$.{n}") for n in names])
    used = guarded(at("used_percentage", "usedPercent", "used_percent").try_cast("double"))
    left = guarded(at("remaining_fraction").try_cast("double"))
    minutes = F.coalesce(guarded(at("windowDurationMins", "window_minutes").try_cast("double")), F.when(F.col("bucket") == "five_hour", 300.0).when(F.col("bucket") == "seven_day", 10080.0)).cast("long")
    rows = rows.select("agent", safe_name(F.coalesce("account", F.lit("local"))).alias("account"), safe_name(F.col("bucket")).alias("bucket"), minutes.alias("window_minutes"), instant(at("resets_at", "resetsAt", "reset_time")).alias("resets_at"), F.coalesce(used, 100 * (1 - left)).alias("used_percent"), instant(F.col("observed_at")).alias("observed_at"))
    return rows.filter("used_percent BETWEEN 0 AND 100").withColumn("id", digest(*[F.col(c).cast("string") for c in ("agent", "account", "bucket", "observed_at", "used_percent", "resets_at")]))


#: SRC-10: where each agent keeps its logs, below the folder that is given.
PLACES = {"codex": ("sessions/**/*.jsonl", "archived_sessions/**/*.jsonl"), "claude": ("projects/**/*.jsonl",), "copilot": ("session-state/*/events.jsonl", "session-state/events.jsonl"), "grok": ("sessions/**/usage.json",)}


def discovered(spark: SparkSession, agent: str, root: str) -> list[str]:
    """SRC-10: the agent's log files in its known folders below root, sorted; links are not followed. The listing is the file system's, so that any
    store that Spark reads can be given; a home folder is never searched as a whole."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    found: set[str] = set()
    for place in PLACES[agent]:
        base, _, name = place.rpartition("/")
        top = fs_path(f"{root.rstrip('/')}/{base.split('/')[0]}")
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            continue
        deep, files = "**" in place, fs.listFiles(top, True)
        while files.hasNext():
            f = files.next()
            path = f.getPath().toString()
            below = path[len(fs.makeQualified(top).toString()) + 1 :]
            fits = path.endswith(".jsonl") if name == "*.jsonl" else f.getPath().getName() == name
            if fits and not f.isSymlink() and (deep or below.count("/") == base.count("/")):
                found.add(path)
    return sorted(found)


def collected(spark: SparkSession, agent: str, root: str) -> tuple[DataFrame, DataFrame] | None:
    """SRC-11: usage rows of all of an agent's files, each identity once, and the sources' quality counters; None where there are no files."""
    files = discovered(spark, agent, root)
    if not files:
        return None
    if agent == "grok":
        usage = reduce(DataFrame.unionByName, [logs.grok(spark, f) for f in files])
        return usage, spark.createDataFrame([(f, 1, 0, None) for f in files], "file string, lines long, malformed_rows long, warning string")
    lines = logs.lines(spark, files)
    adapter = {"codex": logs.codex, "claude": logs.claude, "copilot": logs.copilot}[agent]
    usage = adapter(lines)
    keep = [c for c in usage.columns if c not in ("id", "line")]
    whole = usage.groupBy("id").agg(*[(F.max(c) if c in logs.COUNTERS else F.min(c)).alias(c) for c in keep])
    return whole, logs.quality(lines)


def agy_input(given: Column, read: Column, write: Column, output: Column, total: Column, includes_cache: Column) -> Column:
    """SRC-09: a result's input tokens: as given where it is said to hold the cache and can, with the cache where it is said not to; unknown where cache is
    reported and nothing is said, or where the total differs from input and output."""
    cache = F.coalesce(read, F.lit(0)) + F.coalesce(write, F.lit(0))
    known = F.when(includes_cache, F.when(cache <= given, given)).when(~includes_cache, given + cache)
    return F.when(includes_cache.isNotNull(), known).when((cache == 0) & F.coalesce(total == given + output, F.lit(True)), given)


#: Fixed columns of the store that is read; those from the fourth to the eighth must be numbers.
STORE = ("id", "session_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "created_at")


def sqlite_usage(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: usage rows of SQLite stores, read as whole files into memory, never opened in place: file, problem, id, session_id, model, the counters, ts (the
    store's instants are UTC without an offset). A store of another shape or that cannot be read is one row with its problem."""
    import pyarrow as pa

    def run(batches):
        import sqlite3

        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                con, rows = sqlite3.connect(":memory:"), []
                try:
                    con.deserialize(content.as_py())
                    kinds = {r[1]: r[2].upper() for r in con.execute("PRAGMA table_info(assistant_usage_events)")}
                    if all(c in kinds for c in STORE) and all(any(k in kinds[c] for k in ("INT", "REAL", "FLOA", "DOUB", "NUM", "DEC")) for c in STORE[3:8]):
                        rows = [(file, None, *(None if x is None else str(x) for x in r)) for r in con.execute(f"SELECT {', '.join(STORE)} FROM assistant_usage_events")]
                    else:
                        rows = [(file, "unsupported_sql_schema", *[None] * len(STORE))]
                except sqlite3.Error:
                    rows = [(file, "sql_snapshot_unreadable", *[None] * len(STORE))]
                finally:
                    con.close()
                if rows:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["file", "problem", *STORE])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ", ".join(f"`{c}` string" for c in ("file", "problem", *STORE)))
    naive = F.when(F.col("created_at").rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d+)?$"), F.concat(F.replace("created_at", F.lit(" "), F.lit("T")), F.lit("Z")))
    counts = [guarded(F.col(c).try_cast("double")).cast("long").alias(c) for c in STORE[3:8]]
    return raw.select("file", "problem", digest(F.lit("copilot"), F.lit("sql"), F.col("session_id"), F.col("id")).alias("id"), safe_name(F.col("session_id")).alias("session_id"), safe_name(F.col("model")).alias("model"), *counts, instant(F.coalesce(naive, F.col("created_at"))).alias("ts"))


#: Kinds of evaluation questions.
QUESTION_KINDS = ("where", "trace", "usage", "docs", "symbol", "absent")


def questions(rows: DataFrame, kinds: tuple[str, ...] = QUESTION_KINDS) -> DataFrame:
    """SRC-23: evaluation questions (value: a JSON object a row): id, corpus, question, kind, expected (path, start, end) and problem, which is null for a
    sound one: unique ids, known kinds, ordered positive ranges; only absent questions expect nothing."""
    of = lambda p: F.get_json_object("value", p)
    expected = F.from_json(of("$.expected"), "array<struct<path:string,start:int,end:int>>")
    q = rows.select(*[of(f"$.{c}").alias(c) for c in ("id", "corpus", "question", "kind")], expected.alias("expected"))
    twice = q.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("twice"))
    wrong = F.exists("expected", lambda t: t["path"].isNull() | (t["path"] == "") | ~F.coalesce((t["start"] > 0) & (t["end"] >= t["start"]), F.lit(False)))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    problem = (
        F.when(blank("id") | blank("corpus") | blank("question"), "missing_text").when(F.col("twice"), "duplicate_id").when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "unknown_kind")
        .when(F.col("expected").isNull(), "no_list").when((F.col("kind") == "absent") != (F.size("expected") == 0), "absent_expects_nothing").when(wrong, "invalid_range")
    )
    return q.join(twice, "id", "left").select("id", "corpus", "question", "kind", "expected", problem.alias("problem"))


def engine_results(rows: DataFrame) -> DataFrame:
    """SRC-24: results of an engine (question, value: a JSON object with `results`): place, path, start_line, end_line, text and problem; a text must not have
    more lines than its range, unless the mapping is approximate."""
    each = F.from_json(F.get_json_object("value", "$.results"), "array<struct<path:string,startLine:int,endLine:int,text:string,lineMapping:string>>")
    r = rows.select("question", F.posexplode(each).alias("place", "r")).select("question", (F.col("place") + 1).alias("place"), "r.*")
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + F.when((F.col("text") == "") | F.col("text").endswith("\n"), 0).otherwise(1)
    problem = (
        F.when(F.coalesce(F.col("path") == "", F.lit(True)), "missing_path").when(~F.coalesce((F.col("startLine") > 0) & (F.col("endLine") >= F.col("startLine")), F.lit(False)), "invalid_range").when(F.col("text").isNull(), "missing_text")
        .when((F.coalesce("lineMapping", F.lit("exact")) != "approximate") & (n > F.col("endLine") - F.col("startLine") + 1), "text_exceeds_range")
    )
    return r.select("question", "place", "path", F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line"), "text", problem.alias("problem"))
