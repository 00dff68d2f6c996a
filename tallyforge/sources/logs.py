"""Readers of agent logs: JSON lines with line numbers and quality counters, and adapters to the usage schema (SRC-01 to SRC-05, SRC-07, SRC-08, SRC-30).

A line that is no JSON object is counted, never an error. Every adapter is expressions and aggregates over lines; nothing is
collected. Line numbers are those of the file, so that a file is read by one task and must be smaller than 2 GB; many files are many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.scalars import digest, guarded, instant

COUNTERS = ["input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens"]


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC-01: file, line (1-based), value; blank lines are left out, a byte-order mark too."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n")).alias("line", "value"))
    return rows.filter(F.trim("value") != "").withColumn("line", F.col("line") + 1)


def objects(rows: DataFrame) -> DataFrame:
    """Adds ok: whether the line is a JSON object."""
    return rows.withColumn("ok", F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())


def quality(rows: DataFrame) -> DataFrame:
    """Per file: lines, malformed lines and whether there is a warning."""
    bad = F.count_if(~F.coalesce("ok", F.lit(False)))
    return objects(rows).groupBy("file").agg(F.count(F.lit(1)).alias("lines"), bad.alias("malformed_rows"), F.when(bad > 0, "malformed_or_partial_line").alias("warning"))


def _at(path: str, source: str = "value") -> Column:
    return F.get_json_object(source, path)


def _n(path: str) -> Column:
    """A counter: whole, finite, not negative; booleans and text are null."""
    raw = _at(path)
    return F.when(raw.rlike(r"^-?[0-9.eE+-]+$"), guarded(raw.try_cast("double"))).cast("long")


def _row(agent: str, session: Column, model: Column, ts: Column, counters: dict[str, Column], key: list[Column]) -> list[Column]:
    """FLT-06: the common columns; reasoning above output is unknown."""
    counters = {c: counters.get(c, F.lit(None).cast("long")) for c in COUNTERS}
    counters["reasoning_tokens"] = F.when(counters["reasoning_tokens"] <= counters["output_tokens"], counters["reasoning_tokens"])
    return [digest(F.lit(agent), *key).alias("id"), F.lit(agent).alias("agent"), session.alias("session_id"), F.coalesce(model, F.lit("unknown")).alias("model"), instant(ts).alias("ts"), *[v.alias(k) for k, v in counters.items()]]


def _stem() -> Column:
    return F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)


def _in_subagents() -> Column:
    return F.col("file").rlike("/subagents/[^/]+$")


def _claude_session() -> Column:
    """A subagent's file is a session of its own, whatever id its rows retain."""
    return F.when(_in_subagents(), _stem()).otherwise(F.coalesce(_at("$.sessionId"), _stem()))


def claude(rows: DataFrame) -> DataFrame:
    """SRC-04, AGG-12: assistant rows with usage and a message id; (message, request) is one request across files, with the largest
    counters. Input is fresh + cache reads + cache writes, which are the sum of their two lifetimes where no total is given."""
    base = "$.message.usage"
    fresh, read, write, short, long = (_n(f"{base}.{k}") for k in ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_creation.ephemeral_5m_input_tokens", "cache_creation.ephemeral_1h_input_tokens"))
    write = F.coalesce(write, F.coalesce(short, F.lit(0)) + F.coalesce(long, F.when(short.isNotNull(), 0)), long)
    synthetic = F.coalesce(_at("$.message.model"), F.lit("")).isin("<synthetic>", "synthetic")
    own = objects(rows).filter(F.col("ok") & (_at("$.type") == "assistant") & _at(base).isNotNull() & ~synthetic & _at("$.message.id").isNotNull())
    counters = {
        "input_tokens": fresh + F.coalesce(read, F.lit(0)) + F.coalesce(write, F.lit(0)),
        "cache_read_tokens": read,
        "cache_write_tokens": write,
        "output_tokens": _n(f"{base}.output_tokens"),
        "reasoning_tokens": F.coalesce(_n(f"{base}.reasoning_tokens"), _n(f"{base}.thinking_tokens")),
    }
    key = [_at("$.message.id"), F.coalesce(_at("$.requestId"), _at("$.request_id"))]
    return deduplicated(own.select(*_row("claude", _claude_session(), _at("$.message.model"), _at("$.timestamp"), counters, key), "line"))


def claude_lineage(rows: DataFrame) -> DataFrame:
    """SRC-04: session_id and parent_session_id, from the folder above `subagents` or from the rows; a session without a parent has null."""
    parent = F.when(_in_subagents(), F.regexp_extract("file", "([^/]+)/subagents/[^/]+$", 1)).otherwise(_at("$.parentSessionId"))
    own = objects(rows).filter("ok").select(_claude_session().alias("session_id"), parent.alias("parent"), "line")
    return own.groupBy("session_id").agg(F.min_by("parent", F.when(F.col("parent").isNotNull(), F.col("line"))).alias("parent_session_id"))


def deduplicated(out: DataFrame) -> DataFrame:
    known = F.min_by("model", F.when(F.col("model") != "unknown", F.col("line")))
    return out.groupBy("id").agg(F.min("agent").alias("agent"), F.min_by("session_id", "line").alias("session_id"), F.coalesce(known, F.lit("unknown")).alias("model"), F.min("ts").alias("ts"), *[F.max(c).alias(c) for c in COUNTERS])


#: A snapshot's or response's counters, and the names that a thread's total goes by.
CODEX = {"input_tokens": "input_tokens", "cache_read_tokens": "cached_input_tokens", "output_tokens": "output_tokens", "reasoning_tokens": "reasoning_output_tokens"}
THREAD_TOTALS = ["thread_token_usage", "thread_total", "thread_total_usage", "thread_total_token_usage", "total_token_usage"]


def _first(paths: list[str], source: str = "value") -> Column:
    return F.coalesce(*[F.when(_at(p, source) != "", _at(p, source)) for p in paths])


def _rollouts(rows: DataFrame) -> DataFrame:
    """Lines with what their file says of itself: the last session_meta's line and content, the own and the parent session, whether what
    follows may be a parent's replay, the first native record after the meta, and each line's turn and model."""
    own = objects(rows).filter("ok").select("file", "line", "value", _at("$.type").alias("type"), _at("$.payload.type").alias("inner"))
    file = Window.partitionBy("file")
    is_meta, is_turn = F.col("type") == "session_meta", F.col("type") == "turn_context"
    own = own.withColumns({"meta": F.coalesce(F.max(F.when(is_meta, F.col("line"))).over(file), F.lit(0)), "about": F.max_by(F.when(is_meta, F.col("value")), F.when(is_meta, F.col("line"))).over(file)})
    base, spawn = "$.payload", "$.payload.source.subagent.thread_spawn"
    parent = _first([f"{base}.{k}" for k in ("forked_from_id", "parent_thread_id", "parent_session_id")] + [f"{p}.{k}" for p in (f"{base}.source.subagent", spawn) for k in ("parent_thread_id", "parent_session_id")], "about")
    own = own.withColumns({"session": F.coalesce(_first([f"{base}.{k}" for k in ("id", "session_id", "thread_id")], "about"), _stem()), "parent": parent})
    pending = _first([f"{base}.forked_from_id"], "about").isNotNull() | (F.col("meta") > 1) | (F.col("parent").isNotNull() & F.coalesce(_at(spawn, "about"), F.lit("{}")).isin("{}", "null"))
    native = (F.col("line") > F.col("meta")) & ((F.col("type") == "token_usage_record") | F.coalesce(F.col("inner") == "token_usage_record", F.lit(False)))
    own = own.withColumns({"pending": pending, "native": native, "after": F.col("line") > F.col("meta")})
    forward = file.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    turn = is_turn & F.col("after")
    own = own.withColumns({
        "first_native": F.min(F.when(F.col("native"), F.col("line"))).over(file),
        "model": F.last(F.when(turn, _at(f"{base}.model")), ignorenulls=True).over(forward),
        "current": F.last(F.when(turn, F.struct(_at(f"{base}.turn_id").alias("id"))), ignorenulls=True).over(forward)["id"],
    })
    return own.drop("about")


def codex_lineage(rows: DataFrame) -> DataFrame:
    """SRC-03: session_id and parent_session_id of each rollout."""
    return _rollouts(rows).select(F.col("session").alias("session_id"), F.col("parent").alias("parent_session_id")).distinct()


def codex(rows: DataFrame) -> DataFrame:
    """SRC-03, WIN-01 to WIN-03, JOIN-01. Two kinds of records give the usage of a file, after its last session_meta:

    native: one a response, with the model of its turn, else the model before it; records of other threads are inherited and left out, as
    are those without a response id; a response met twice has the largest counters.
    legacy: token_count snapshots become increments, with the model before them. An equal snapshot gives nothing, a fall counts only if it
    starts anew from the row's own usage. Only snapshots before the first native record count, and of these only those that do not pass
    the thread's total which that record started from.

    Snapshots before the meta are the baseline of a fork's own. A fork without any takes its parent's snapshots, where the parent's
    rollout is among the rows: the leading ones that equal them are replay, the last of which is the baseline. A fork without any baseline has
    no legacy usage.
    """
    own = _rollouts(rows)
    total, last = "$.payload.info.total_token_usage", "$.payload.info.last_token_usage"
    snaps = own.filter((F.col("type") == "event_msg") & (F.col("inner") == "token_count") & ~F.coalesce(_at(total), F.lit("{}")).isin("{}", "null"))
    snaps = snaps.select("*", *[_n(f"{total}.{k}").alias(f"t_{c}") for c, k in CODEX.items()], *[_n(f"{last}.{k}").alias(f"f_{c}") for c, k in CODEX.items()])
    snaps = snaps.withColumn("point", F.concat_ws(",", *[F.coalesce(F.col(f"t_{c}").cast("string"), F.lit("-")) for c in CODEX]))
    of_parents = snaps.select(F.col("session").alias("parent"), "point", F.lit(True).alias("replay")).distinct()
    snaps = snaps.join(of_parents, ["parent", "point"], "left").withColumn("replay", F.coalesce("replay", F.lit(False)) & F.col("after"))
    file = Window.partitionBy("file")
    snaps = snaps.withColumns({"inherits": F.max(~F.col("after")).over(file), "first_replay": F.min(F.when(F.col("replay"), F.col("line"))).over(file)})
    forked = F.col("pending") & ~F.col("inherits")
    snaps = snaps.withColumn("own_from", F.min(F.when(F.col("after") & (~forked | (~F.col("replay") & (F.col("line") > F.col("first_replay")))), F.col("line"))).over(file))
    baseline = ~F.col("after") | (forked & (F.col("line") >= F.col("first_replay")))
    w = file.orderBy("line")
    snaps = snaps.filter((F.col("line") >= F.col("own_from")) | baseline).withColumns({f"p_{c}": F.lag(f"t_{c}").over(w) for c in CODEX} | {"first": F.row_number().over(w) == 1})
    fell, same, fresh = F.lit(False), F.lit(True), F.lit(True)
    for c in CODEX:
        t, p, f = (F.col(f"{x}_{c}") for x in "tpf")
        fell, same, fresh = fell | F.coalesce(t < p, F.lit(False)), same & t.eqNullSafe(p), fresh & t.eqNullSafe(f)
    snaps = snaps.withColumns({"fell": fell, "same": same & ~F.col("first"), "fresh": fresh}).filter("line >= own_from AND NOT same AND (NOT fell OR fresh) AND (first_native IS NULL OR line < first_native)")
    at_first = own.filter("line = first_native").select("file", *[(_first_count(THREAD_TOTALS, c) - _n(f"$.payload.usage.{c}")).alias(f"b_{c}") for c in ("input_tokens", "output_tokens")])
    proven = F.col("first_native").isNull() | F.coalesce((F.col("t_input_tokens") <= F.col("b_input_tokens")) & (F.col("t_output_tokens") <= F.col("b_output_tokens")), F.lit(False))
    snaps = snaps.join(at_first, "file", "left").filter(proven)
    counters = {c: F.when(F.col("first") | F.col("fell"), F.col(f"t_{c}")).otherwise(F.col(f"t_{c}") - F.col(f"p_{c}")) for c in CODEX}
    legacy = snaps.select(*_row("codex", F.col("session"), F.col("model"), _at("$.timestamp"), counters, [F.col("session"), *[F.col(f"t_{c}").cast("string") for c in CODEX], F.col("line").cast("string")]))

    said = own.filter((F.col("type") == "turn_context") & F.col("after")).select("file", _at("$.payload.turn_id").alias("turn"), _at("$.payload.model").alias("turn_model"), "line")
    turns = said.filter("turn IS NOT NULL").groupBy("file", "turn").agg(F.max_by("turn_model", "line").alias("turn_model"))
    response, thread = _first(["$.payload.response_id", "$.payload.responseId"]), _first(["$.payload.thread_id", "$.payload.threadId"])
    native = own.filter(F.col("native") & response.isNotNull() & (F.coalesce(thread, F.col("session")) == F.col("session"))).withColumn("turn", F.coalesce(_first(["$.payload.turn_id"]), "current"))
    native = native.join(turns, ["file", "turn"], "left")
    native = native.select(*_row("codex", F.col("session"), F.coalesce("turn_model", "model"), _at("$.timestamp"), {c: _n(f"$.payload.usage.{k}") for c, k in CODEX.items()}, [F.col("session"), F.lit("native"), response]), "line")
    return legacy.unionByName(deduplicated(native))


def _first_count(names: list[str], counter: str) -> Column:
    """The counter of the first of the objects that is there."""
    told = F.coalesce(*[F.when(~_at(f"$.payload.{n}").isin("null", ""), _at(f"$.payload.{n}")) for n in names])
    raw = F.get_json_object(told, f"$.{counter}")
    return F.when(raw.rlike(r"^-?[0-9.eE+-]+$"), guarded(raw.try_cast("double"))).cast("long")


def copilot(rows: DataFrame) -> DataFrame:
    """SRC-05: two shapes of request events."""
    own = objects(rows).filter(F.col("ok") & _at("$.type").isin("model.model_call_success", "assistant.usage"))
    call = _at("$.type") == "model.model_call_success"
    pick = lambda a, b: F.when(call, _n(a)).otherwise(_n(b))
    counters = {
        "input_tokens": pick("$.data.responseUsage.prompt_tokens", "$.data.inputTokens"),
        "output_tokens": pick("$.data.responseUsage.completion_tokens", "$.data.outputTokens"),
        "cache_read_tokens": pick("$.data.responseUsage.prompt_tokens_details.cached_tokens", "$.data.cacheReadTokens"),
        "reasoning_tokens": pick("$.data.responseUsage.completion_tokens_details.reasoning_tokens", "$.data.reasoningTokens"),
    }
    model = F.coalesce(_at("$.data.modelCall.model"), _at("$.data.model"))
    request = F.coalesce(_at("$.data.modelCall.request_id"), _at("$.data.requestId"), F.concat_ws(":", "file", "line"))
    return deduplicated(own.select(*_row("copilot", F.coalesce(_at("$.sessionId"), F.col("file")), model, _at("$.timestamp"), counters, [request]), "line"))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: file, value (null where the file is no JSON object) and warning, a row a file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    ok = F.coalesce(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull(), F.lit(False))
    return raw.select("file", F.when(ok, F.col("value")).alias("value"), F.when(~ok, "malformed_json").alias("warning"))


def grok(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02, SRC-07: one JSON object a file; modelUsage is a map by model or a list with models. A total unlike input + output leaves input unknown."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.try_parse_json("value").isNotNull())
    turn = raw.select("file", _at("$.sessionId").alias("session"), F.posexplode(F.from_json(_at("$.turns"), "array<string>")).alias("line", "value"))
    usage = _at("$.modelUsage")
    each = F.when(usage.startswith("["), F.transform(F.from_json(usage, "array<string>"), lambda x: F.struct(F.get_json_object(x, "$.model").alias("key"), x.alias("value")))).otherwise(F.map_entries(F.from_json(usage, "map<string,string>")))
    rows = turn.select("file", "session", "line", _at("$.turnId").alias("turn"), _at("$.timestamp").alias("at"), F.explode(each).alias("u")).select("*", F.col("u.key").alias("own"), F.col("u.value").alias("value"))
    total = F.coalesce(_n("$.totalTokens") == _n("$.inputTokens") + _n("$.outputTokens"), F.lit(True))
    counters = {"input_tokens": F.when(total, _n("$.inputTokens")), "output_tokens": _n("$.outputTokens"), "cache_read_tokens": _n("$.cachedReadTokens"), "cache_write_tokens": _n("$.cacheCreationTokens"), "reasoning_tokens": _n("$.reasoningTokens")}
    return rows.select(*_row("grok", F.col("session"), F.col("own"), F.col("at"), counters, [F.col("session"), F.coalesce("turn", F.col("line").cast("string")), F.col("own")]))


def agy(rows: DataFrame) -> DataFrame:
    """SRC-08, WIN-04: a conversation's results are cumulative and preferred; without any, its finished steps are increments."""
    own = objects(rows).filter("ok").select("file", "line", "value", _at("$.type").alias("type"), _at("$.conversation_id").alias("session"), _at("$.timestamp").alias("at"), _n("$.usage.input_tokens").alias("i"), _n("$.usage.output_tokens").alias("o"))
    has = own.filter("type = 'result'").select("session").distinct()
    w = Window.partitionBy("session").orderBy(F.coalesce("at", F.lit("")), "line")
    results = own.filter("type = 'result'").withColumns({"pi": F.lag("i").over(w), "po": F.lag("o").over(w)})
    fell = F.coalesce(F.col("i") < F.col("pi"), F.lit(False)) | F.coalesce(F.col("o") < F.col("po"), F.lit(False))
    delta = lambda c: F.when(fell, F.col(c)).otherwise(F.col(c) - F.coalesce(f"p{c}", F.lit(0)))
    results = results.select("session", "line", "at", delta("i").alias("i"), delta("o").alias("o"))
    steps = own.filter((F.col("type") == "step_update") & (_at("$.state") == "DONE")).join(has, "session", "left_anti").select("session", "line", "at", "i", "o")
    both = results.unionByName(steps)
    return both.select(*_row("agy", F.col("session"), F.lit(None).cast("string"), F.col("at"), {"input_tokens": F.col("i"), "output_tokens": F.col("o")}, [F.col("session"), F.col("line").cast("string")]))


def quotas(rows: DataFrame) -> DataFrame:
    """SRC-30: the primary and secondary buckets of every token event, whatever its usage."""
    own = objects(rows).filter(F.col("ok") & _at("$.payload.rate_limits").isNotNull())
    bucket = F.array(*[F.struct(F.lit(b).alias("bucket"), _at(f"$.payload.rate_limits.{b}.used_percent").try_cast("double").alias("used_percent"), _n(f"$.payload.rate_limits.{b}.window_minutes").alias("window_minutes")) for b in ("primary", "secondary")])
    return own.select("file", "line", instant(_at("$.timestamp")).alias("ts"), F.explode(bucket).alias("q")).select("file", "line", "ts", "q.*").filter(F.col("used_percent").between(0, 100))
