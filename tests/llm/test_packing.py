import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import packing


def test_encoder_is_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    known, plain = packing.Encoder(path, None), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    assert known.by_chunk
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "The", "é", "ñ1", "12", "'s", "'", "!!", "...", " ", " ", "日本", "<|endoftext|>", "x" * 70, "🙂", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(known.one(text), known.code).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, ids_of, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, r.ids, r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        at, got = 0, []
        for start, length, ids, n in sorted(pieces):
            assert start == at and n == len(ids_of[doc]) and length >= 1
            at += length
            got += np.frombuffer(ids, "<u4").tolist()
        assert got == ids_of[doc]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0


def test_whole_and_gapless(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "c,", "d.\ne"]) for _ in range(rng.randrange(400))), rng.choice(["hot", "hot", "a", "b", None])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "word " * 30000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).withColumn("n", F.lit(1)).withColumn("ids", F.lit(1))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows}
    check(packing.packed(df).collect(), ids_of, 2048)
    check(packing.packed(df, window=64, burst=16, cycle=8, targets={"a": 3, "hot": 1}).collect(), ids_of, 64)


def test_small_sources_share_a_queue(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 2)
    rows = [(i, "word " * (i % 37 + (200 if i % 9 == 0 else 0)), ["big", "rest", None, *[f"s{k}" for k in range(20)]][0 if i % 9 == 0 else i % 23]) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = {i: plain.encode(t, add_special_tokens=False).ids + [1] for i, t, _ in rows}
    got = packing.packed(df, window=64, burst=16, cycle=8).collect()
    check(got, ids_of, 64)
    assert {r.doc_id: r.source for r in got} == {i: s or "" for i, _, s in rows}
    check(packing.packed(df, window=64, burst=16, cycle=8, targets={"s3": 1}).collect(), ids_of, 64)


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_schedule_meets_targets():
    totals = {"a": 3_000_000, "b": 1_000_000, "c": 500_000}
    plan = packing.Schedule(totals, {"a": 1, "b": 1, "c": 2})
    share = defaultdict(lambda: defaultdict(int))
    for s, n in totals.items():
        for _, took, window, _ in plan.pieces(s, 0, n):
            share[window][s] += took
    assert all(sum(x.values()) == 2048 for w, x in share.items() if w < plan.lengths[0])
    carried = defaultdict(float)
    for w in range(400):  # all have tokens left: every window is near its targets, and what it misses is carried
        for s, part in (("a", 0.25), ("b", 0.25), ("c", 0.5)):
            carried[s] += share[w][s] - 2048 * part
            assert abs(carried[s]) <= 2 * packing.BURST + 1


def test_crc_is_that_of_the_ids(spark):
    row = packing.packed(spark.createDataFrame([(1, "one two", "s")], "doc_id long, text string, source string")).select("*", F.crc32("ids").alias("crc")).first()
    assert row.crc == zlib.crc32(bytes(row.ids))
