"""Fragments of source text: detectors, escapes, excerpts, contexts (SCL-10, SCL-14, SCL-15, SCL-27, SCL-28, SORT-08, WIN-15, TXT-09, TXT-14, FLT-11, FLT-25). What needs a parser or
looks back and forth runs in Arrow batches."""

from __future__ import annotations

import ast
import bisect
import json
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyforge.functions.scalars import primary_terms, stem, words

#: Languages whose comments are /* */ and //.
BRACED = ("javascript", "typescript", "tsx", "java", "c", "cpp", "c_sharp", "go", "rust", "kotlin", "swift", "scala", "groovy", "dart")
#: Names of files that hold credentials.
CREDENTIALS = ("auth.json", "credentials.json", ".credentials.json", "hosts.yml", "secrets.env", "oauth_creds.json")
SECRET_KEY = re.compile(r"(?i)(password|passwd|secret|token|api[_-]?key|authorization|cookie|credential|private[_-]?key)")


#: SCL-14, fixed patterns: declarations of what a file depends on, with "S" for a string.
WEB_IMPORTS = r'\b(?:import|export)\b[^;(\n]*?(?:from\s+)?"S"\s*;?|\b(?:const|let|var)\s+(?:[\w$]+|\{[^{};]*\})\s*=\s*require\(\s*"S"\s*\)\s*;?'
IMPORTS = r'(?m)^\s*#\s*include\s*(?:<[^>\n]+>|"S")[^\S\n]*$|\b(?:package|import|using|use)\s+(?:static\s+)?[\w.*:]+\s*;?|\bimport\s*\(\s*(?:"S"\s*)+\)'
#: TXT-09, fixed pattern: section and key lines of configurations.
CONFIG_KEY = r"""^(?:\[[^\]]+\]|["\w.-]+["']?\s*[:=]|<(?![!?/])[\w:.-]+)"""


def usage_path(path: str) -> str:
    """FLT-11: the path, unless its name is that of a file with credentials."""
    name = re.split(r"[/\\]", path)[-1]
    if name.lower() in CREDENTIALS or name.startswith(".env"):
        raise ValueError("files with credentials are no usage sources")
    return path


@F.arrow_udf(T.StringType())
def properties_text(text: pa.Array) -> pa.Array:
    r"""SCL-10: \uXXXX after an odd number of backslashes becomes its character; halves of a pair are joined, lone halves are replaced."""

    def character(m: re.Match) -> str:
        slashes = m[1]
        return slashes[1:] + chr(int(m[2], 16)) if len(slashes) % 2 else m[0]

    def whole(x: str | None) -> str | None:
        return x if x is None else re.sub(r"(\\+)u([0-9a-fA-F]{4})", character, x).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    return pa.array([whole(x) for x in text.to_pylist()], pa.string())


def comment_only(text: Column, language: Column) -> Column:
    """SCL-15: whether nothing but comments is left of a fragment (in languages with braces); also the tail of a block comment."""
    bare = F.trim(F.regexp_replace(text, r"/\*[\s\S]*?\*/|//[^\n]*", ""), F.lit(" \t\r\n"))
    lines = F.filter(F.transform(F.split(bare, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    tail = F.coalesce(F.try_element_at(lines, F.lit(-1)) == "*/", F.lit(False)) & F.forall(lines, lambda x: x.startswith("*"))
    return language.isin(*BRACED) & (F.trim(text, F.lit(" \t\r\n")) != "") & ((bare == "") | tail)


def _imports_alone(text: str) -> bool:
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        return False
    return all(isinstance(n, ast.Import | ast.ImportFrom) or (isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str)) for n in body)


@F.arrow_udf(T.BooleanType())
def python_preamble(text: pa.Array) -> pa.Array:
    return pa.array([bool(x and x.strip()) and _imports_alone(x) for x in text.to_pylist()], pa.bool_())


def preamble(text: Column, language: Column) -> Column:
    """SCL-14: whether a fragment only declares what it depends on: imports and doc strings in Python; comments and import, package, using, include and
    require lines elsewhere. Strings count as one opaque piece, so that an address in one is no comment."""
    opaque = F.regexp_replace(text, r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|/\*[\s\S]*?\*/|//[^\n]*""", "$1")
    opaque = F.regexp_replace(opaque, r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)""", '"S"')
    left = F.when(language.isin("javascript", "typescript", "tsx"), F.regexp_replace(opaque, WEB_IMPORTS, "")).otherwise(F.regexp_replace(opaque, IMPORTS, ""))
    known = language.isin(*BRACED, "php") & (F.trim(text, F.lit(" \t\r\n")) != "")
    return F.when(language == "python", python_preamble(text)).otherwise(known & (F.trim(left, F.lit(" \t\r\n")) == ""))


def _clean(value: object, known: Iterable[str]) -> object:
    if isinstance(value, dict):
        return {k: "[redacted]" if SECRET_KEY.search(k) else _clean(v, known) for k, v in value.items()}
    if isinstance(value, list):
        return [_clean(v, known) for v in value]
    if isinstance(value, str):
        for secret in known:
            value = value.replace(secret, "[redacted]")
    return value


def scrubbed(text: Column, known: list[str] = ()) -> Column:
    """FLT-25, FLT-20: JSON text with the values of secret-named fields, at any depth, and the known values, longest first, taken out; text that is no
    JSON loses the known values alone."""
    longest = sorted(filter(None, known), key=len, reverse=True)

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            try:
                out.append(x if x is None else json.dumps(_clean(json.loads(x), longest), ensure_ascii=False, separators=(",", ":")))
            except (ValueError, RecursionError):
                out.append(_clean(x, longest))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text)


def excerpts(units: DataFrame) -> DataFrame:
    """SORT-08: units (question, text, start_line, room) with their best whole lines that fit into `room` characters: excerpt, first_line, last_line, or
    nulls. The line with most of the question's stems is the start (the first of equals); then lines are added on the side that
    is nearer to it, as long as they fit, line ends included."""

    def widened(sizes: list[int], hits: list[int], room: int) -> tuple[int, int] | None:
        at = max(range(len(sizes)), key=lambda i: (hits[i], -i))
        if sizes[at] > room:
            return None
        lo = hi = at
        used = sizes[at]
        while True:
            sides = [i for i in (lo - 1, hi + 1) if 0 <= i < len(sizes) and used + sizes[i] + 1 <= room]
            if not sides:
                return lo, hi
            i = min(sides, key=lambda i: abs(i - at))
            used += sizes[i] + 1
            lo, hi = min(lo, i), max(hi, i)

    def run(sizes: pa.Array, hits: pa.Array, room: pa.Array) -> pa.Array:
        out = [widened(s, h, r) if s and r and r > 0 else None for s, h, r in zip(*(x.to_pylist() for x in (sizes, hits, room)), strict=True)]
        return pa.array([None if x is None else {"lo": x[0], "hi": x[1]} for x in out], pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    lines = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    terms = F.transform(primary_terms(F.col("question")), stem)
    hits = F.transform(F.col("lines"), lambda x: F.size(F.array_intersect(F.transform(words(x), stem), F.col("terms"))))
    rows = units.withColumns({"lines": lines, "terms": terms})
    found = F.arrow_udf(run, "struct<lo: int, hi: int>")(F.transform(F.col("lines"), lambda x: F.length(x)), hits, F.col("room"))
    rows = rows.withColumn("at", found)
    part = F.array_join(F.slice("lines", F.col("at.lo") + 1, F.col("at.hi") - F.col("at.lo") + 1), "\n")
    return rows.select(*units.columns, F.when(F.col("at").isNotNull(), part).alias("excerpt"), (F.col("start_line") + F.col("at.lo")).alias("first_line"), (F.col("start_line") + F.col("at.hi")).alias("last_line"))


def config_contexts(lines: DataFrame) -> DataFrame:
    """TXT-09: lines (path, line, value) of configurations with the nearest section or key line at or before them: context, context_line. Before the first, the
    file's first line stands."""
    own = F.when(F.trim("value").rlike(CONFIG_KEY), F.struct(F.trim("value").alias("text"), "line"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    near = F.coalesce(F.last(own, ignorenulls=True).over(w), F.first(F.struct(F.trim("value").alias("text"), F.lit(1).cast(lines.schema["line"].dataType).alias("line"))).over(w))
    return lines.withColumn("near", near).select(*lines.columns, F.col("near.text").alias("context"), F.col("near.line").alias("context_line"))


def member_slice(files: DataFrame, members: DataFrame, selector: str, most: int = 200) -> DataFrame:
    """TXT-14: numbered lines of the members (path, id, name, kind, start_line, end_line) that a selector names: by the whole id, else by what follows `#` or the
    last dot, else by a name that is no type's; in files (path, text); `rest` tells how many lines were left out beyond `most`."""
    level = F.when(F.col("id") == selector, 3).when(F.element_at(F.split("id", "#"), -1) == selector, 2).when((F.col("name") == selector) & (F.col("kind") != "type"), 1)
    hits = members.withColumn("level", level).filter("level IS NOT NULL")
    top = hits.agg(F.max("level").alias("level"))
    hits = hits.join(F.broadcast(top), "level")  # one row
    n = F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(most))
    rows = hits.join(files.select("path", F.split("text", r"\r?\n").alias("lines")), "path")
    part = F.transform(F.slice("lines", F.col("start_line"), n), lambda x, i: F.concat((F.col("start_line") + i).cast("string"), F.lit(": "), x))
    return rows.select("path", "id", F.array_join(part, "\n").alias("slice"), (F.col("end_line") - F.col("start_line") + 1 - n).alias("rest"))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))
def overlapping_windows(lines: pa.Array, most: pa.Array) -> pa.Array:
    """WIN-15: windows of whole lines (1-based, inclusive): up to 48 lines and `most` characters with the ends between them, one line at least; the next window
    repeats up to eight lines of the last, fewer where they leave no room for a new one, so that each window adds a line."""
    out = []
    for texts, room in zip(lines.to_pylist(), most.to_pylist(), strict=True):
        upto = [0]
        for x in texts or []:
            upto.append(upto[-1] + len(x) + 1)
        n, lo, spans = len(upto) - 1, 0, []
        while lo < n:
            hi = max([h for h in range(lo + 1, min(n, lo + 48) + 1) if upto[h] - upto[lo] - 1 <= room], default=lo + 1)
            spans.append({"first": lo + 1, "last": hi})
            if hi == n:
                break
            lo = next((s for s in range(max(lo + 1, hi - 8), hi) if upto[hi + 1] - upto[s] - 1 <= room), hi)
        out.append(spans)
    return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))


#: Characters that JSON writes as two, and the most that a span may be worth.
TWO, LARGEST = frozenset('\\"\b\f\n\r\t'), 1500


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def escaped_spans(text: pa.Array, most: pa.Array) -> pa.Array:
    """SCL-28: half-open spans of a text whose JSON form has at most `most` (and 1500) characters each; they end after a blank line where there is one,
    else after a line, else after a word, else anywhere."""
    out = []
    for x, room in zip(text.to_pylist(), most.to_pylist(), strict=True):
        upto, spans, at = [0], [], 0
        for c in x or "":
            upto.append(upto[-1] + (2 if c in TWO else 6 if c < " " else 1))
        limit = max(1, min(room, LARGEST))
        while at < len(upto) - 1:
            end = max(at + 1, bisect.bisect_right(upto, upto[at] + limit) - 1)
            if end < len(upto) - 1:
                part = x[at:end]
                ends = [part.rfind(mark) + len(mark) for mark in ("\n\n", "\n") if mark in part]
                word = max((i + 1 for i in range(1, len(part)) if part[i].isspace()), default=0)
                end = at + (ends[0] if ends else word or len(part))
            spans.append({"start": at, "end": end})
            at = end
        out.append(spans)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


_PIECE = re.compile(r'"(?:\\.|[^"\\])*"|[{}\[\],:]')


def member_span(text: str, name: str) -> tuple[int, int] | None:
    """SCL-27: where the value of an object's own member stands in its text (half-open); the last of equal names counts, nested names do not."""
    depth, key, begin, found = 0, None, None, None
    last = None
    for m in _PIECE.finditer(text):
        piece = m[0]
        if piece in "{[":
            depth += 1
        elif depth == 1 and piece == ":":
            key, begin = last, m.end()
        elif depth == 1 and piece in ",}" and begin is not None:
            if json.loads(key) == name:
                value = text[begin : m.start()]
                found = begin + len(value) - len(value.lstrip()), begin + len(value.rstrip())
            begin = None
        if piece in "}]":
            depth -= 1
            if not depth:
                return found
        last = piece if piece[0] == '"' else last
    return None
