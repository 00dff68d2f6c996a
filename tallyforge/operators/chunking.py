"""Text and code structure: definitions, units, members (TXT-01 to TXT-14).

Parsing one file needs that file alone, so the generators are mapInPandas over files: path, language and text in, a row for each unit out.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

UNIT = "path string, title string, kind string, start_line int, end_line int, text string, uid string"
DEFINITION = "path string, name string, kind string, start_line int, end_line int, signature string, doc string"
MEMBER = "path string, id string, kind string, start_line int, end_line int, token_hash string, body_hash string"
TAG = "path string, line int, kind string, ident string"
#: Target size of a unit in characters other than white space.
TARGET = 1500


def _mapped(rows: DataFrame, one: Callable[[str, str, str], Iterator[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, *u) for p, lang, t in zip(b["path"], b["language"], b["text"], strict=True) for u in one(p, lang, t or "")]
            yield pd.DataFrame(out, columns=names)

    return rows.select("path", "language", "text").mapInPandas(run, schema)


def python_definitions(text: str) -> Iterator[tuple]:
    """TXT-01: functions and classes with their scope; a text that does not parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = text.split("\n")

    def walk(node: ast.AST, scope: str) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{scope}.{child.name}".lstrip(".")
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                yield name, "class" if isinstance(child, ast.ClassDef) else "function", first, child.end_lineno, lines[child.lineno - 1].strip(), ast.get_docstring(child)
                yield from walk(child, name)
            else:
                yield from walk(child, scope)

    yield from walk(tree, "")


_START = re.compile(r"^\s*(?:(?:export|public|private|protected|static|final|abstract|async|default|pub|unsafe|virtual|inline)\s+)*(?:(class|interface|enum|struct|trait|impl|record|module)\s+([A-Za-z_]\w*)|(?:function|func|fn|def|sub)\s+([A-Za-z_]\w*)|[\w<>\[\],.?&*: ]+\s[*&]?([A-Za-z_]\w*)\s*\([^;{]*\)[^;{]*\{)")
_NO_NAME = {"if", "for", "while", "switch", "catch", "return", "else", "do", "new", "throw"}


def brace_definitions(text: str) -> Iterator[tuple]:
    """TXT-02 for languages with braces: a definition ends where its braces balance; strings and comments are passed over."""
    bare = re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    lines, raw = bare.split("\n"), text.split("\n")
    for i, line in enumerate(lines):
        found = _START.match(line)
        name = found and (found[2] or found[3] or found[4])
        if not name or name in _NO_NAME:
            continue
        depth, opened, end = 0, False, i
        for k in range(i, len(lines)):
            depth += lines[k].count("{") - lines[k].count("}")
            opened = opened or "{" in lines[k]
            if opened and depth <= 0 or not opened and ";" in lines[k]:
                end = k
                break
        else:
            end = len(lines) - 1
        yield name, "class" if found[2] else "function", i + 1, end + 1, raw[i].strip(), None


def definitions(rows: DataFrame) -> DataFrame:
    """TXT-01, TXT-02 by language."""
    return _mapped(rows, lambda _, language, text: python_definitions(text) if language == "python" else brace_definitions(text), DEFINITION)


def packed_lines(lines: list[str], start: int, end: int, target: int = TARGET) -> Iterator[tuple[int, int]]:
    """WIN-14: windows of whole lines (0-based, end exclusive) of up to target characters that are no white space."""
    at, size = start, 0
    for i in range(start, end):
        n = len(re.sub(r"\s", "", lines[i]))
        if size and size + n > target:
            yield at, i
            at, size = i, 0
        size += n
    if at < end:
        yield at, end


def _unit(path: str, title: str, kind: str, lines: list[str], lo: int, hi: int) -> tuple:
    text = "\n".join(lines[lo:hi])
    return title, kind, lo + 1, hi, text, hashlib.sha256(f"{path}\0{title}\0{lo}\0{hi}\0{text}".encode()).hexdigest()[:24]


def code_units(path: str, language: str, text: str) -> Iterator[tuple]:
    """TXT-05: units along outermost definitions; what lies between is packed; long ones are cut into parts."""
    lines = text.removesuffix("\n").split("\n")
    found = sorted((d[2] - 1, -d[3], d[0]) for d in (python_definitions(text) if language == "python" else brace_definitions(text)))
    at, spans = 0, []
    for lo, minus, name in found:
        if lo >= at:
            spans += [(at, lo, ""), (lo, -minus, name)]
            at = -minus
    for lo, hi, name in [*spans, (at, len(lines), "")]:
        for a, b in packed_lines(lines, lo, hi):
            if any(x.strip() for x in lines[a:b]):
                yield _unit(path, name, "code", lines, a, b)


def docs_units(path: str, text: str) -> Iterator[tuple]:
    """TXT-06, WIN-13: sections of Markdown under their breadcrumbs; fenced lines are no headings."""
    lines = text.removesuffix("\n").split("\n")
    trail, start, fenced, title = [], 0, False, ""

    def flush(end: int) -> Iterator[tuple]:
        for a, b in packed_lines(lines, start, end):
            if any(x.strip() for x in lines[a:b]):
                yield _unit(path, title, "docs", lines, a, b)

    for i, line in enumerate(lines):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        head = None if fenced else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if head:
            yield from flush(i)
            trail = [t for t in trail if t[0] < len(head[1])] + [(len(head[1]), head[2])]
            start, title = i, " > ".join(t for _, t in trail)
    yield from flush(len(lines))


def notebook_units(path: str, text: str) -> Iterator[tuple]:
    """TXT-08: a unit for each cell; line numbers count the cells' own lines one after another."""
    try:
        cells = json.loads(text)["cells"]
    except (ValueError, KeyError, TypeError):
        return
    at = 0
    for k, cell in enumerate(cells):
        lines = "".join(cell.get("source", [])).split("\n")
        title, kind, _, _, body, uid = _unit(path, f"cell {k + 1}", "docs" if cell.get("cell_type") == "markdown" else "code", lines, 0, len(lines))
        yield title, kind, at + 1, at + len(lines), body, uid
        at += len(lines)


def units(rows: DataFrame) -> DataFrame:
    """TXT-10, TXT-11: units of files by language."""

    def one(path: str, language: str, text: str) -> Iterator[tuple]:
        if language == "notebook":
            return notebook_units(path, text)
        return docs_units(path, text) if language in ("markdown", "rst") else code_units(path, language, text)

    return _mapped(rows, one, UNIT)


def tags(rows: DataFrame) -> DataFrame:
    """TXT-12: definitions and references of identifiers by line, without repeats."""

    def one(path: str, language: str, text: str) -> Iterator[tuple]:
        defined = {(d[2], d[0].rsplit(".", 1)[-1]) for d in (python_definitions(text) if language == "python" else brace_definitions(text))}
        yield from sorted((line, "Def", name) for line, name in defined)
        used = {(i + 1, m[0]) for i, line in enumerate(text.split("\n")) for m in re.finditer(r"[A-Za-z_]\w+", line)}
        yield from sorted((line, "Ref", name) for line, name in used - defined)

    return _mapped(rows, one, TAG)


def java_members(text: str) -> Iterator[tuple]:
    """TXT-13: types, methods and fields by lexical scan, with hashes of tokens (name included) and of the body alone."""
    types: list[tuple[str, int]] = []
    for name, kind, lo, hi, _, _ in brace_definitions(text):
        types = [t for t in types if t[1] >= lo]
        owner = ".".join(t[0] for t in types)
        lines = text.split("\n")[lo - 1 : hi]
        words = re.findall(r"\w+|[^\s\w]", re.sub(r"//[^\n]*|/\*.*?\*/", "", "\n".join(lines), flags=re.S))
        body = words[words.index("{") :] if "{" in words else []
        digest = lambda w: hashlib.sha256(" ".join(w).encode()).hexdigest()
        yield f"{owner}.{name}".lstrip("."), "type" if kind == "class" else "method", lo, hi, digest(words), digest(body)
        if kind == "class":
            types.append((name, hi))


def members(rows: DataFrame) -> DataFrame:
    return _mapped(rows, lambda _path, _language, text: java_members(text), MEMBER)
