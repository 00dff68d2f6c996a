"""Repository inventory as DataFrames: files, decoding, ignore rules, secrets (SRC-17 to SRC-22, FLT-14 to FLT-19, STR-01)."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalars import secret_spans

#: Languages by suffix.
LANGUAGES = {"py": "python", "java": "java", "js": "javascript", "ts": "typescript", "rs": "rust", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "rb": "ruby", "md": "markdown", "rst": "rst", "html": "html", "sql": "sql", "json": "json", "ipynb": "notebook", "toml": "toml", "yaml": "yaml", "yml": "yaml"}
SECRET_NAMES = (".env", ".netrc", ".npmrc", ".pypirc", "credentials", "id_rsa", "id_ed25519", "id_ecdsa", "id_dsa")
SECRET_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".jks", ".keystore")


def secret_path(path: Column) -> Column:
    """FLT-17: names and suffixes of files that hold secrets."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.isin(*SECRET_NAMES) | name.rlike(r"^\.env\.|" + "|".join(re.escape(s) + "$" for s in SECRET_SUFFIXES)) | F.lower(path).rlike(r"(^|[/_.-])secrets?([/_.-]|$)")


def glob_pattern(glob: str) -> str:
    """FLT-16: *, ? and [sets] as a regular expression over one path segment's characters (** crosses segments)."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
            if glob[i : i + 1] == "/":
                out, i = out[:-2] + "(.*/)?", i + 1
            continue
        end = glob.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
            continue
        out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return out


def ignored(path: Column, rules: list[str]) -> Column:
    """FLT-15: ordered ignore rules; `!` takes back, a leading or inner slash anchors, a trailing one means folders; the last match wins."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.removeprefix("!")
        folder, body = rule.endswith("/"), rule.strip("/")
        start = "^" if rule.startswith("/") or "/" in body else "(^|.*/)"
        hit = path.rlike(start + glob_pattern(body) + ("/.*$" if folder else "(/.*)?$"))
        out = F.when(hit, F.lit(not back)).otherwise(out)
    return out


def inventory(spark: SparkSession, root: str, excludes: list[str] = (), rules: list[str] = (), max_bytes: int = 2_000_000) -> DataFrame:
    """path, size, mtime, sha256, language, skip (why a file is left out, or null) and content of the files that stay. Spark lists
    neither hidden nor empty files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^[a-z]+:/*", "/")
    path = F.substr(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.length(base) + 1)
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    language = F.coalesce(*[F.when(suffix == s, F.lit(n)) for s, n in LANGUAGES.items()], F.lit("other"))
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for x in excludes:
        out = out | (path == x) | path.startswith(x.rstrip("/") + "/") | (name == x)
    skip = F.when(secret_path(path), "secret").when(out, "excluded").when(ignored(path, list(rules)), "ignored").when(F.col("length") > max_bytes, "too_large")
    rows = rows.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content", language.alias("language"), skip.alias("skip"))
    return rows.withColumn("sha256", F.when(F.col("skip").isNull(), F.sha2("content", 256))).withColumn("content", F.when(F.col("skip").isNull(), F.col("content")))


def declared(raw: bytes) -> str | None:
    """SRC-22: an encoding cookie, an XML prolog or a meta tag."""
    head = raw[:1024]
    for pattern in (rb"^(?:[^\n]*\n)?[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)", rb"<\?xml[^>]*encoding=[\"']([-\w.]+)", rb"(?i)<meta[^>]*charset=[\"']?([-\w.]+)"):
        if found := re.search(pattern, head):
            try:
                return codecs.lookup(found[1].decode()).name
            except LookupError:
                return None
    return None


def decoded(raw: bytes, fallbacks: tuple[str, ...] = ()) -> tuple[str | None, str | None]:
    """SRC-21: text with LF line ends and its encoding; (None, None) for binary content."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            tries = [name]
            break
    else:
        lanes = [raw[k:4096:2].count(0) / max(1, len(raw[k:4096:2])) for k in (0, 1)]
        if lanes[1] > 0.3 > lanes[0] or lanes[0] > 0.3 > lanes[1]:
            tries = ["utf-16-le" if lanes[1] > lanes[0] else "utf-16-be"]
        elif 0 in raw:
            return None, None
        else:
            tries = [*filter(None, [declared(raw)]), "utf-8", *fallbacks, "cp1252", "latin-1"]
    for name in tries:
        try:
            text = raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        if sum(c < " " and c not in "\t\n\r\f" for c in text) > 0.02 * max(1, len(text)):
            return None, None
        return text.replace("\r\n", "\n").replace("\r", "\n"), name
    return None, None


def texts(files: DataFrame, fallbacks: tuple[str, ...] = ()) -> DataFrame:
    """path, language, sha256, text, encoding of the files that decode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [decoded(bytes(x), fallbacks) for x in b["content"]]
            yield b[["path", "language", "sha256"]].assign(text=[t for t, _ in both], encoding=[e for _, e in both])

    rows = files.filter("skip IS NULL AND content IS NOT NULL").select("path", "language", "sha256", "content")
    return rows.mapInPandas(run, "path string, language string, sha256 string, text string, encoding string").filter("text IS NOT NULL")


def secret_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """FLT-18: lines (1-based, inclusive) that secrets cover, a row a secret: path, first, last. A private key covers its body."""
    return rows.select("path", F.inline(secret_spans(F.col(text))))


def with_redaction(units: DataFrame, secrets: DataFrame) -> DataFrame:
    """FLT-19: units (path, start_line, end_line) with redacted: whether a secret's lines meet theirs."""
    by_file = secrets.groupBy("path").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("secret_lines"))
    hit = F.exists("secret_lines", lambda x: (x["first"] <= F.col("end_line")) & (x["last"] >= F.col("start_line")))
    return units.join(by_file, "path", "left").withColumn("redacted", F.coalesce(hit, F.lit(False))).drop("secret_lines")


def java_texts(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """SRC-27: path, text of Java files in the given encoding, which is never guessed; a file that it does not fit raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["path"]].assign(text=[_strict(p, bytes(x), encoding) for p, x in zip(b["path"], b["content"], strict=True)])

    rows = files.filter(F.lower("path").endswith(".java") & F.col("content").isNotNull()).select("path", "content")
    return rows.mapInPandas(run, "path string, text string")


def _strict(path: str, raw: bytes, encoding: str) -> str:
    try:
        return raw.decode(encoding).removeprefix("﻿")
    except UnicodeDecodeError as error:
        raise ValueError(f"{path} is not {encoding}: give the encoding of the build") from error
