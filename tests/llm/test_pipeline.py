from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tallyforge.llm import exact_dedup, minhash, toxicity

STAGES = dict(corpus_pipeline.STAGES)


def tokens(docs):
    return docs.agg(F.sum(F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), "\\s+")))).first()[0]


def test_stages_keep_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "exact dedup":
            want = {r.doc_id for r in exact_dedup.exact_groups(docs).filter("kept").collect()}
        elif name == "MinHash near-dedup":
            want = {r.doc_id for r in minhash.near_groups(docs).filter("kept").collect()}
        elif name == "toxicity":
            want = {r.doc_id for r in toxicity.scored(docs, labels).filter("predicted = 0").collect()}
        else:
            want = None
        had = tokens(docs)
        path = corpus_pipeline.scratch(spark, "test-stage")
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        got = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(got) == len(set(got)) and set(got) <= ids, name
        if want is None:
            assert tokens(docs) > 0.85 * had  # what the targets allow, whatever the stage says
        else:
            assert set(got) == want, name
        ids = set(got)
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, d).collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == ids
    for p in pieces.values():
        assert sum(n for _, n, _ in p) == p[0][2] and sorted(p)[0][0] == 0


def test_null_and_repeated_ids(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (1, "other text", "s"), (2, "alpha beta", "s"), (3, "alpha beta", "s"), (2, "third", "s"), (None, "c", "s"), (None, "c", "t"), (None, "d", "s"), (4, "d", "s"), (5, None, "s"), (6, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rest = [(1, "a b"), (1, "other text"), (2, "alpha beta"), (2, "third"), (4, "d"), (None, "c")]
    for stage, empty in ((corpus_pipeline.drop_exact_copies, [(5, None)]), (corpus_pipeline.drop_near_copies, [(5, None), (6, "")])):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, rest + empty))


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_long_and_clashing_columns(spark, name):
    d = "/root/testdata/sf0.001"
    columns = "doc_id long, text string, source string, row long, mix int, times int, key int, bucket string, id int, n int"
    assert STAGES[name](spark, spark.createDataFrame([], columns), d).count() == 0
    rows = [(1, "plain words here", "s"), (2, "long " * 300_000, "s"), (3, None, None), (4, "é\n" * 9, "t")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, "b", 5, 6) for r in rows], columns)
    got = STAGES[name](spark, docs, d)
    assert name == "packing" or got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} <= {1, 2, 3, 4} and (name == "mixing" or got.count() >= 3)


def test_mixing_keeps_most_clean_tokens(spark):
    d = "/root/testdata/sf0.01"
    docs = corpus_pipeline.reject_toxic(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    had, kept = tokens(docs), tokens(corpus_pipeline.mix(spark, docs, d))
    print("kept share", kept / had)
    assert kept > 0.9 * had
