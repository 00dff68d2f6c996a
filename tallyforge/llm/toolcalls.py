"""Chat formatting: tool-call linking.

Calls (conv_id, turn, call_id, name, arguments, after) and results (conv_id, turn, call_id, content) meet in a hash join by
conversation and identifier, in either order; what has no partner stays, with its status. A call comes after the calls
that `after` names and those whose identifiers its arguments hold as {"$call": id}. Calls are topologically ordered: `depth` is
the longest chain of calls before it, and (depth, turn, call_id) is an order in which nothing comes before what it needs. Depths are
found for all conversations together, by joins: chains of calls that need one other each are followed in doubling steps, so
that a chain of n calls takes log n rounds, and what is left, calls that need several, takes a round for each such call on the
longest path. No conversation of any size is gathered in a task. Calls in a cycle, or after one, have no depth.
Arguments are checked against the tool's schema (type, properties, required, additionalProperties, items, enum, minimum,
maximum, minLength, maxLength), and each pair becomes one line of canonical JSON: sorted keys, no spaces, non-ASCII kept
(but lone surrogates, which UTF-8 cannot hold, are escaped).

Nulls, ties, empties: a null identifier joins with nothing; of repeated calls (or results) of an identifier the one with the smallest turn, then
the smallest text, counts, the others are statused `repeated`; null or malformed arguments (not JSON, a number beyond a double, nested
too deeply to read) are invalid, not an error, and stand in the line as the text that they are; a call
without a schema is `unknown_tool`; dependencies on missing calls are ignored; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyforge.llm.shared import bounded, dropped, stored

#: Turns in a block of the search for the last user turn; a conversation of any length is dealt out in blocks.
TURNS = 1024
#: What reading and checking texts may raise: no JSON, a wrong shape, too deep, too large a number.
WRONG = (ValueError, TypeError, RecursionError, OverflowError)
#: JSON Schema's type names.
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    def plain(v: Any) -> Any:
        if isinstance(v, float) and math.isfinite(v) and v == int(v) and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return escaped(text)


def escaped(text: str) -> str:
    """The text with its lone surrogates as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def faults(value: Any, schema: dict, at: str = "$") -> Iterator[str]:
    """What in a value goes against a schema."""
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if want := schema.get("type"):
        fits = [number if t == "number" else number and value == int(value) if t == "integer" else isinstance(value, KINDS[t]) for t in ([want] if isinstance(want, str) else want)]
        if not any(fits):
            yield f"{at}: not {want}"
            return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{at}: not in enum"
    if number:
        if value < schema.get("minimum", value):
            yield f"{at}: below minimum"
        if value > schema.get("maximum", value):
            yield f"{at}: above maximum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            yield f"{at}: too short"
        if len(value) > schema.get("maxLength", len(value)):
            yield f"{at}: too long"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            yield from faults(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                yield f"{at}.{k}: missing"
        for k, x in value.items():
            if k in own:
                yield from faults(x, own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                yield f"{at}.{k}: unexpected"


def mentioned(value: Any) -> Iterator[str]:
    if isinstance(value, dict):
        if set(value) == {"$call"} and isinstance(value["$call"], str):
            yield value["$call"]
        for x in value.values():
            yield from mentioned(x)
    elif isinstance(value, list):
        for x in value:
            yield from mentioned(x)


def parsed(text: str | None) -> Any:
    def refuse(name: str) -> None:
        raise ValueError(name)

    def number(digits: str) -> float:
        if not math.isfinite(x := float(digits)):
            raise ValueError(digits)
        return x

    value = json.loads(text, parse_constant=refuse, parse_float=number)
    canonical(value)  # what cannot be written again is malformed everywhere
    return value


@F.arrow_udf(T.ArrayType(T.StringType()))
def references(arguments: pa.Array) -> pa.Array:
    out = []
    for text in arguments.to_pylist():
        try:
            out.append(sorted(x for x in set(mentioned(parsed(text))) if escaped(x) == x))  # no identifier holds a lone surrogate
        except WRONG:
            out.append([])
    return pa.array(out, pa.list_(pa.string()))


def chains(edges: DataFrame) -> DataFrame:
    """conv_id, call_id, head, far: for calls that need exactly one other, the first call up the chain that does not, and how far
    it is. Each round doubles the distance that has been followed; calls of a cycle, or behind one, are left out."""
    spark = edges.sparkSession
    one = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("head")).filter("n = 1").select("conv_id", "call_id", "head", F.lit(1).cast("long").alias("far"))
    now = stored(one, "calls-chain")
    inside = now.select("conv_id", F.col("call_id").alias("head"), F.lit(True).alias("more"))
    now = stored(now.join(inside, ["conv_id", "head"], "left").select("conv_id", "call_id", "head", "far", F.coalesce("more", F.lit(False)).alias("open")), "calls-chain")
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):  # an acyclic chain is not longer than their number
        if now.filter("open").isEmpty():
            break
        up = now.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("up"), F.col("far").alias("further"), F.col("open").alias("still"))
        step = now.filter("open").join(up, ["conv_id", "head"]).select("conv_id", "call_id", F.col("up").alias("head"), (F.col("far") + F.col("further")).alias("far"), F.col("still").alias("open"))
        after = stored(now.filter("NOT open").unionByName(step), "calls-chain")
        dropped(spark, now)
        now = after
    return now.filter("NOT open").select("conv_id", "call_id", "head", "far")


def depths(edges: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of calls that depend on others (edges: conv_id, call_id, needs; both are calls); depth null: no order."""
    every = edges.select("conv_id", "call_id").distinct()
    chain = stored(chains(edges), "calls-chains")
    lone = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("head")).filter("n = 1").select("conv_id", "call_id")
    several = edges.join(lone, ["conv_id", "call_id"], "left_anti")
    ends = several.join(chain.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left")
    broken = lone.join(chain.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("never"))
    ends = ends.join(broken, ["conv_id", "needs"], "left").select("conv_id", "call_id", F.coalesce("head", "needs").alias("head"), F.coalesce("far", F.lit(0)).alias("far"), F.coalesce("never", F.lit(False)).alias("never"))
    ends = stored(ends, "calls-left")
    waiting = ends.select("conv_id", "call_id").distinct()
    known = stored(waiting.limit(0).withColumn("depth", F.lit(0).cast("long")), "calls-known")
    while True:  # calls all of whose needs are known; heads that need nothing are
        heads = waiting.select("conv_id", F.col("call_id").alias("head"), F.lit(True).alias("waits")).join(known.withColumnRenamed("call_id", "head"), ["conv_id", "head"], "left")
        state = ends.join(known.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").join(heads, ["conv_id", "head"], "left")
        state = state.groupBy("conv_id", "call_id").agg(F.max(F.col("never") | (F.col("waits").isNotNull() & F.col("depth").isNull())).alias("blocked"), (F.max(F.coalesce("depth", F.lit(0)) + F.col("far")) + 1).alias("depth"))
        last = stored(state.filter("NOT blocked").select("conv_id", "call_id", "depth"), "calls-last")
        if last.isEmpty():
            break
        after = stored(known.unionByName(last), "calls-known")
        dropped(edges.sparkSession, known, last)
        known = after
    heads = known.withColumnRenamed("call_id", "head").join(waiting.withColumnRenamed("call_id", "head").withColumn("waits", F.lit(True)), ["conv_id", "head"], "full_outer")
    along = chain.join(heads, ["conv_id", "head"], "left").filter("waits IS NULL OR depth IS NOT NULL").select("conv_id", "call_id", (F.coalesce("depth", F.lit(0)) + F.col("far")).alias("depth"))
    return every.join(known.unionByName(along), ["conv_id", "call_id"], "left")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with nth: 1 for the first of an identifier by `order`, one row even of equal ones, and for each null identifier; 2 for the
    others. Equal rows are counted on the map side and told apart again at the end, so that a repeated identifier is no hot window."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times"))
    first = counted.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct(*order)).alias("first"))
    first = first.select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_call"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("call_id") == F.col("f_call"))
    top = F.col("call_id").isNull() | F.col("first").eqNullSafe(F.struct(*order))
    each = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
    both = counted.join(first, same, "left").select(*rows.columns, top.alias("top"), each.alias("k"))
    return both.select(*rows.columns, F.when(F.col("call_id").isNull() | (F.col("top") & (F.col("k") == 1)), 1).otherwise(2).alias("nth"))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call or unmatched result: conv_id, call_id, call_turn, result_turn, name, depth, status, faults (array), line."""
    bounded(calls.sparkSession)
    calls = calls.select("conv_id", F.col("turn").alias("call_turn"), F.col("call_id").cast("string").alias("call_id"), "name", "arguments", F.array_sort(F.coalesce("after", F.array().cast("array<string>"))).alias("after"))
    results = results.select("conv_id", F.col("turn").alias("result_turn"), F.col("call_id").cast("string").alias("call_id"), "content")
    calls = stored(numbered(calls, ["call_turn", "arguments", "name", "after"]), "calls-numbered")
    results = stored(numbered(results, ["result_turn", "content"]), "calls-results")
    first = results.filter("nth = 1").withColumn("found", F.lit(True))
    same = (F.col("c.conv_id") == F.col("r.conv_id")) & (F.col("c.call_id") == F.col("r.call_id")) & (F.col("c.nth") == 1)
    both = calls.alias("c").hint("shuffle_hash").join(first.alias("r"), same, "full_outer").select(
        F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), F.coalesce("c.call_id", "r.call_id").alias("call_id"), "call_turn", "result_turn", "name", "arguments", "content", "found", F.col("c.nth").alias("nth")
    )
    more = results.filter("nth > 1").select("conv_id", "call_id", F.lit(None).cast("long").alias("call_turn"), "result_turn", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "content", F.lit(True).alias("found"), "nth")
    both = both.unionByName(more)

    ids = calls.filter("nth = 1 AND call_id IS NOT NULL").select("conv_id", "call_id")
    needs = calls.filter("nth = 1 AND call_id IS NOT NULL").select("conv_id", "call_id", F.explode(F.array_distinct(F.concat("after", references("arguments")))).alias("needs"))
    edges = needs.join(ids.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi").select("conv_id", "call_id", "needs").distinct()
    depth = depths(stored(edges, "calls-edges")).withColumn("late", F.lit(True))
    both = both.join(depth, ["conv_id", "call_id"], "left")
    none = F.lit(None).cast("long")
    both = both.withColumn("depth", F.when(F.col("nth").isNull() | F.col("call_turn").isNull() & F.col("name").isNull() & F.col("arguments").isNull(), none).when(F.col("late"), F.col("depth")).otherwise(F.lit(0).cast("long")))
    shared = calls.sparkSession.sparkContext.broadcast(schemas)

    def checked(names: pa.Array, arguments: pa.Array) -> pa.Array:
        out = []
        for name, text in zip(names.to_pylist(), arguments.to_pylist(), strict=True):
            schema = shared.value.get(name)
            try:
                out.append(["unknown_tool"] if schema is None else sorted(map(escaped, faults(parsed(text), schema))))
            except WRONG:
                out.append(["malformed"])
        return pa.array(out, pa.list_(pa.string()))

    def line(conv: pa.Array, call: pa.Array, name: pa.Array, arguments: pa.Array, content: pa.Array) -> pa.Array:
        out = []
        for c, i, n, a, r in zip(*(x.to_pylist() for x in (conv, call, name, arguments, content)), strict=True):
            try:
                a = parsed(a)
            except WRONG:
                pass
            out.append(canonical({"conversation": c, "id": i, "name": n, "arguments": a, "result": r}))
        return pa.array(out, pa.string())

    is_call = F.col("call_turn").isNotNull() | F.col("name").isNotNull() | F.col("arguments").isNotNull()
    status = F.when(F.col("nth") > 1, "repeated").when(~is_call, "no_call").when(F.col("found").isNull(), "no_result").when(F.col("depth").isNull(), "cyclic").otherwise("linked")
    wrong = F.when(is_call, F.arrow_udf(checked, "array<string>")("name", "arguments")).otherwise(F.array().cast("array<string>"))
    text = F.arrow_udf(line, "string")("conv_id", "call_id", "name", "arguments", "content")
    return both.select("conv_id", "call_id", "call_turn", "result_turn", "name", "depth", status.alias("status"), wrong.alias("faults"), text.alias("line"))


#: The tool that turns of a plain conversation are calls of.
REPLY = {"reply": {"type": "object", "required": ["prompt"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1}, "context": {"type": "object"}}}}


def last_before(rows: DataFrame, mark: Column) -> DataFrame:
    """conv_id, turn, asked: for each turn the largest smaller one that has a marked row. Blocks of TURNS turns are searched on their own, then
    blocks by what the ones before them hold, so that one long conversation is no hot window."""
    turns = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn", F.floor(F.col("turn") / TURNS).alias("block")).agg(F.max(F.when(mark, F.col("turn"))).alias("marked"))
    own = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").agg(F.max("marked").alias("marked"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.max("marked").over(earlier).alias("earlier"))
    found = turns.withColumn("near", F.max("marked").over(own)).join(blocks, ["conv_id", "block"])
    return found.select("conv_id", "turn", F.coalesce("near", "earlier").alias("asked"))


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a conversation table: each user turn calls `reply`, needs the call of the user turn before it, and is
    answered by the first assistant turn after it (an identifier is that of the last user turn before). Rows without a conversation
    or a turn take part with a null identifier."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    before = last_before(rows, F.col("role") == "user")
    name = lambda turn: F.when(F.col("conv_id").isNotNull() & F.col(turn).isNotNull(), F.concat_ws("-", "conv_id", turn))
    rows = rows.join(before, ["conv_id", "turn"], "left")
    user = rows.filter("role = 'user'")
    needs = F.when(F.col("asked").isNotNull(), F.struct(name("asked").alias("$call")))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.size(F.split("text", " ")).alias("words"), needs.alias("context")))
    calls = user.select("conv_id", "turn", name("turn").alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array().cast("array<string>").alias("after"))
    return calls, rows.filter("role = 'assistant'").select("conv_id", "turn", name("asked").alias("call_id"), F.col("text").alias("content"))
