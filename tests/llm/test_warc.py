import gzip
import hashlib

import pytest
from tallyforge.llm import warc
from tallyforge.llm.shared import scratch

ARC1 = b"filedesc://a.arc 0.0.0.0 19990102030405 text/plain 68\n1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n\nhttp://x.org/a b 1.2.3.4 199901020304 text/html 32\nHTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\r\n\r\n\ndns:x.org 1.2.3.4 19990102030405 text/dns 5\nhello\nnot a header\nhttp://y 1.2.3.4 1999 text/plain 3\nabc\n"
ARC2 = b"filedesc://b.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 b.arc 15\n2 0 Someone\nxx\nhttp://z/ 9.9.9.9 20010101000000 text/html 404 abc - 71 b.arc 24\nHTTP/1.1 404 No\n\nnothing\n"


@pytest.mark.parametrize("squeeze", [lambda b: b, gzip.compress, lambda b: gzip.compress(b[:120]) + gzip.compress(b[120:])])
def test_parse_versions(squeeze):
    got = [(v, f["url"], block, s) for _, v, f, block, s in warc.parse_arc(squeeze(ARC1))]
    assert [g[1] for g in got] == [b"filedesc://a.arc", b"http://x.org/a b", b"dns:x.org", b"http://y"]
    assert got[1][2] == b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\r\n\r\n"[:32] and got[2][2] == b"hello" and got[3][3] == 1
    second = list(warc.parse_arc(squeeze(ARC2)))
    assert [x[1] for x in second] == [2, 2] and second[1][2]["status"] == b"404" and warc.split_http(second[1][3]) == (b"HTTP/1.1 404 No\n\n", b"nothing")


def test_dates():
    assert warc.warc_date(b"199901020304") == "1999-01-02T03:04:00Z"
    assert warc.warc_date(b"1999") == "1999-01-01T00:00:00Z"
    assert warc.warc_date(b"20010203040506789") == "2001-02-03T04:05:06Z"


def test_convert_and_round_trip(spark):
    arcs = spark.createDataFrame([("d/a.arc", bytearray(ARC1)), ("d/b.arc", bytearray(ARC2))], "path string, content binary")
    records = warc.with_revisits(warc.converted(arcs))
    assert {(r.uri, r.type, r.date) for r in records.collect()} == {
        ("filedesc://a.arc", "warcinfo", "1999-01-02T03:04:05Z"), ("http://x.org/a b", "response", "1999-01-02T03:04:00Z"), ("dns:x.org", "resource", "1999-01-02T03:04:05Z"),
        ("http://y", "resource", "1999-01-01T00:00:00Z"), ("filedesc://b.arc", "warcinfo", "2001-01-01T00:00:00Z"), ("http://z/", "response", "2001-01-01T00:00:00Z"),
    }
    path = scratch(spark, "warc-test")
    warc.written(records, path)
    back = warc.read_warc(spark, path).collect()
    assert len(back) == 6 and all(r.sound for r in back) and len({r.record_id for r in back}) == 6
    assert {r.payload_bytes for r in back if r.uri == "http://z/"} == {7}


def test_archived(spark):
    long = "é" * 600
    rows = [(1, "http://a/", long), (2, "http://b/ x", long), (5, None, long), (3, "http://c/", "short"), (4, "http://d/", "short"), (6, "", None), (7, "http://e", "WARC/1.1\r\n\r\n\x00" * 300), (8, "http://f", "x" * 3_000_000), (9, "u", "y" * 1000), (10, "u", "y" * 999)]
    got = {r.page_id: r for r in warc.archived(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, type int").repartition(3)).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].sound) == (len(data), hashlib.sha1(data).hexdigest(), True)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 5) if i in (1, 2) else ("response", None))
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_ids_near_the_ends_of_a_long(spark):
    ids = [2**63 - 1, 10**18, 5, -(2**63)]
    rows = spark.createDataFrame([(i, "u", "z" * 2000) for i in ids], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived(rows).collect()}
    assert got == {i: ("response", None) if i == 2**63 - 1 else ("revisit", 2**63 - 1) for i in ids}
    assert warc.long_of(b"9223372036854775808") is None


def test_padding_after_the_last_member():
    assert warc.unzipped(gzip.compress(b"a") + gzip.compress(b"b") + b"\0" * 700) == b"ab"


def test_large_pages_go_into_files_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    rows = spark.createDataFrame([(i, "u", str(i) + "x" * (60_000 if i % 4 == 0 else 100)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    records = warc.with_revisits(warc.converted(warc.arcs_of(rows)))
    path = scratch(spark, "warc-test")
    warc.written(records, path)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) == 5 and max(sizes) < 200_000
    assert sorted(r.page_id for r in warc.read_warc(spark, path).filter("type = 'response'").collect()) == list(range(40))
