"""WARC: a converter of legacy ARC archives.

read: an ARC file (or gzip members of one) starts with a `filedesc:` block whose second line names the format's
version; version 1 header lines end in `IP date type length`, version 2 lines in `IP date type status checksum location
offset filename length`, and whatever stands before is the URL, spaces included. The declared length says how many bytes
follow; a line that is no header is skipped and counted in `skipped`. convert: each record gets a WARC identifier (from
the archive's name, the place in it and the header line, so that a task that is run again gives the same), a date, a type (`filedesc:`
warcinfo, HTTP messages response, anything else resource) and SHA-1 digests of block and payload. Records of equal payloads
of at least LEAST bytes become revisits of the one with the largest order key. write: the records go through Spark's text
writer, whose committer survives lost executors, into uncompressed WARC 1.1 files. read_warc: archives are split by their
declared lengths, one file a row, whose bytes are bounded by how files are written.

Nulls, ties, empties: a null html is an empty payload; a null or blank URL becomes `about:blank`, white space in a URL is escaped; rows
with equal page_id (or none) are records of their own, and of equal payloads with the same key the largest identifier is the response; a
null page_id is below all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import bounded, scratch, stored

#: Payloads from this size on are deduplicated; bytes in a generated ARC; records of up to SMALL bytes in a WARC file, and the bytes that a
#: file of larger ones has at most (but for one record that is larger by itself): a file is read as one row.
LEAST, ARC_BYTES, RECORDS_PER_FILE, SMALL, FILE_BYTES = 1000, 4 << 20, 4000, 16 << 10, 64 << 20
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: What follows the URL on a header line, by version.
TAIL = {
    1: re.compile(rb"^(?P<url>.*\S) (?P<ip>\S+) (?P<date>\d{4,17}) (?P<mime>\S+) (?P<length>\d+)\r?$"),
    2: re.compile(rb"^(?P<url>.*\S) (?P<ip>\S+) (?P<date>\d{4,17}) (?P<mime>\S+) (?P<status>\S+) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\S+) (?P<name>\S+) (?P<length>\d+)\r?$"),
}


def unzipped(content: bytes) -> bytes:
    """Gzip members one after another, or the bytes as they are."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data.lstrip(b"\0")  # files may be padded with zeros
    return b"".join(out)


def parse_arc(content: bytes) -> Iterator[tuple[int, int, dict[str, bytes], bytes, int]]:
    """(place, version, header fields, block, lines skipped so far) of each record, the filedesc block included."""
    content = unzipped(content)
    at, version, skipped, n = 0, 1, 0, len(content)
    while at < n:
        end = content.find(b"\n", at)
        end = n if end < 0 else end
        line = content[at:end]
        if not line.strip():
            at = end + 1
            continue
        if line.startswith(b"filedesc:") and content[end + 1 : end + 3] in (b"1 ", b"2 "):
            version = int(content[end + 1 : end + 2])  # the block's first line names the version of its own header line too
        head = TAIL[version].match(line) or TAIL[3 - version].match(line)
        if not head or end + 1 + int(head["length"]) > n:
            at, skipped = end + 1, skipped + 1
            continue
        block = content[end + 1 : end + 1 + int(head["length"])]
        yield at, version, head.groupdict(), block, skipped
        at = end + 1 + len(block)


def warc_date(date: bytes) -> str:
    """An ARC date (up to 14 digits; what is missing is the earliest) as an ISO 8601 instant."""
    d = date.decode()[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and body of an HTTP message; anything else is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(p + len(s)) for s in (b"\r\n\r\n", b"\n\n") if (p := block.find(s)) >= 0]
    cut = min(ends, default=len(block))
    return block[:cut], block[cut:]


def header(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].strip() if found else None


def sha1_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def long_of(digits: bytes | None) -> int | None:
    """A decimal number within a long's range."""
    if digits and re.fullmatch(rb"-?\d{1,19}", digits) and -(2**63) <= int(digits) < 2**63:
        return int(digits)
    return None


RECORD = "record_id string, type string, uri string, date string, ip string, mime string, page_id long, head binary, payload binary, block_digest string, payload_digest string, payload_bytes long, same string, version int, skipped int"


def converted(arcs: DataFrame) -> DataFrame:
    """A row per record of ARC files given as path and content (as `binaryFile` reads them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name, rows, size = path.as_py().rsplit("/", 1)[-1], [], 0
                for place, version, f, block, skipped in parse_arc(content.as_py()):
                    uri = f["url"].decode("utf-8", "replace")
                    head, payload = split_http(block)
                    kind = "warcinfo" if uri.startswith("filedesc:") else "response" if head else "resource"
                    page = header(head, b"X-Page-Id") if head else None
                    key = uuid.uuid5(uuid.NAMESPACE_URL, f"{name} {place} {f['length']!r} {uri}")
                    rows.append((f"<urn:uuid:{key}>", kind, uri, warc_date(f["date"]), f["ip"].decode("latin-1"), f["mime"].decode("latin-1"), long_of(page), head, payload, sha1_of(block), sha1_of(payload), len(payload), hashlib.sha256(payload).hexdigest(), version, skipped))
                    size += len(block)
                    if size > ARC_BYTES:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    columns = [c.split() for c in RECORD.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])

    return arcs.select("path", "content").mapInArrow(run, RECORD)


def arcs_of(pages: DataFrame, date: str = "20200101000000") -> DataFrame:
    """ARC files (path, content) that hold a page's html as an HTTP response; version 1 and 2 by turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, body = TaskContext.get().partitionId(), 0, bytearray()
        for batch in batches:
            for page, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
                version = 1 + number % 2
                if not body:
                    about = f"{version} 0 tallyforge\n{FIELDS[version]}\n".encode()
                    plain = f"filedesc://part-{part}-{number}.arc 0.0.0.0 {date} text/plain"
                    body += f"{plain}{' 200 - - 0 -' * (version == 2)} {len(about)}\n".encode() + about + b"\n"
                payload = (html or "").encode()
                own = "" if page is None else f"X-Page-Id: {page}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload
                uri = re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), (url or "").strip()) or "about:blank"
                more = f" 200 - - {len(body)} part-{part}-{number}.arc" if version == 2 else ""
                body += f"{uri} 0.0.0.0 {date} text/html{more} {len(block)}\n".encode() + block + b"\n"
                if len(body) > ARC_BYTES:
                    yield pa.record_batch([pa.array([f"part-{part}-{number}.arc"]), pa.array([bytes(body)], pa.binary())], ["path", "content"])
                    number, body = number + 1, bytearray()
        if body:
            yield pa.record_batch([pa.array([f"part-{part}-{number}.arc"]), pa.array([bytes(body)], pa.binary())], ["path", "content"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "path string, content binary")


def with_revisits(records: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds refers_to (a record_id), refers_uri and refers_date; null for all but revisits."""
    order = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("key"), F.col("record_id").alias("id"), "uri", "date")
    groups = records.filter((F.col("type") == "response") & (F.col("payload_bytes") >= least)).select("same", order.alias("o"))
    groups = stored(groups.groupBy("same").agg(F.max("o").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-groups")
    other = (F.col("type") == "response") & F.col("best").isNotNull() & (F.col("best.id") != F.col("record_id"))
    return records.join(groups, "same", "left").select(*records.columns, *[F.when(other, F.col(f"best.{x}")).alias(f"refers_{y}") for x, y in (("id", "to"), ("uri", "uri"), ("date", "date"))])


def written(records: DataFrame, path: str, largest: int | None = None) -> None:
    """WARC 1.1 files of records with their refers_ columns; a revisit keeps the HTTP head alone. largest: the bytes of the largest
    block or more, if they are known; records of over SMALL bytes go into files of their own, of fewer records."""
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    http = F.length("head") > 0
    line = lambda name, value, where=F.lit(True): F.when(where & value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.col("type"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri"), F.col("type") != "warcinfo"),
        line("WARC-Filename", F.col("uri"), F.col("type") == "warcinfo"),
        line("WARC-IP-Address", F.col("ip"), F.col("type") == "response"),
        line("WARC-Block-Digest", F.when(~again, F.col("block_digest"))),
        line("WARC-Payload-Digest", F.col("payload_digest"), F.col("type") != "warcinfo"),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), again),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        line("WARC-Refers-To-Date", F.col("refers_date")),
        line("Content-Type", F.when(http, F.lit("application/http; msgtype=response")).otherwise(F.when(F.col("type") == "warcinfo", F.lit("text/plain")).otherwise(F.col("mime")))),
        line("Content-Length", F.length(block).cast("string")),
        F.lit("\r\n"),
    )
    value = F.concat(F.encode(head, "UTF-8"), block)
    if largest is None:
        largest = records.agg(F.max(F.length(block))).first()[0] or 0
    parts = [(records, RECORDS_PER_FILE)]
    if largest > SMALL:
        parts = [(records.filter(F.length(block) <= SMALL), RECORDS_PER_FILE), (records.filter(F.length(block) > SMALL), max(1, FILE_BYTES // largest))]
    for rows, per_file in parts:
        rows.select(value.cast("string").alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers in lower case, block) of each record, by declared lengths."""
    content = unzipped(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(b": ", 1) for x in content[at:end].split(b"\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        stop = end + 4 + int(fields[b"content-length"])
        yield fields, content[end + 4 : stop]
        at = stop + 4


READ = "record_id string, type string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to string, sound boolean"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record. payload_digest is bare hexadecimal; sound: the payload there has that digest (true for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for f, block in parse_warc(content.as_py()):
                    head, payload = split_http(block)
                    digest = f.get(b"warc-payload-digest", b"")
                    bare = base64.b32decode(digest[5:]).hex() if digest.startswith(b"sha1:") else None
                    again = f[b"warc-type"] == b"revisit"
                    size = int(header(head, b"Content-Length") or 0) if again else len(payload)
                    page = header(head, b"X-Page-Id") if head else None
                    text = [f.get(k) for k in (b"warc-record-id", b"warc-type", b"warc-target-uri", b"warc-date")]
                    rows.append((*(t and t.decode("utf-8", "replace") for t in text), int(page) if page else None, size, bare, (f.get(b"warc-refers-to") or b"").decode() or None, again or bare is None or hashlib.sha1(payload).hexdigest() == bare))
                if rows:
                    kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.bool_()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def archived(pages: DataFrame) -> DataFrame:
    """pages through ARC into WARC files and back: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), uri, record_id."""
    spark = pages.sparkSession
    bounded(spark)
    path = scratch(spark, "warc")
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    written(with_revisits(converted(arcs_of(pages))), path, largest + 1024)
    rows = stored(read_warc(spark, path).filter("type IN ('response', 'revisit')"), "warc-read")
    first = rows.filter("type = 'response'")
    again = rows.filter("type = 'revisit'").join(first.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("other")), "refers_to", "left")
    both = first.withColumn("other", F.lit(None).cast("long")).unionByName(again)
    return both.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("other").alias("refers_to"), "uri", "record_id", "sound")
