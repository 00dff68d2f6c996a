import hashlib
import re

from tallyforge.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {(i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}


def test_groups(spark):
    rows = [(1, "a b c"), (2, "abc"), (3, "a  b c"), (4, "a\t b\nc"), (5, None), (6, ""), (7, " \n"), (8, "é x"), (9, "éx"), (10, "z" * 300000), (11, "z" * 300000)]
    rows += [(100 + i, "copy of one") for i in range(50)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), capacity=5, bits=6)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_empty_and_other_columns(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a", 9, 9), (2, "a ", 8, 8)], "doc_id long, text string, key int, bucket int")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(df).collect()) == [(1, 2), (2, 2)]


def test_directory_doubles():
    assert exact_dedup.directory({0: 1, 5: 1}, 3, 10) == ([0], 0)
    slots, depth = exact_dedup.directory({0: 4, 1: 4, 7: 1}, 3, 5)
    assert depth == 3 and slots == [0, 1, 2, 2, 3, 3, 3, 3]
    assert exact_dedup.directory({3: 100}, 2, 5)[1] == 2  # one cell can't be split further


def test_extreme_ids_and_chosen_rows(spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "ab"), (None, "a b"), (None, "c"), (7, "c "), (7, "c"), (7, "c ")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows_too=True).collect()
    assert {r.keep_id for r in got if r.group_size == 3} == {-(2**63)} and {r.keep_id for r in got if r.group_size == 4} == {7}
    assert sum(r.chosen for r in got if r.group_size == 4) == 2 and sum(r.chosen for r in got if r.group_size == 3) == 1


def test_index_is_read_without_a_shuffle(spark):
    rows = spark.createDataFrame([(i, f"text {i % 40}") for i in range(200)], "doc_id long, text string")
    heads = exact_dedup.entries(rows).groupBy("key", "digest").agg(exact_dedup.best(), exact_dedup.F.count("*").alias("size"))
    table, depth = exact_dedup.lookup(heads, 5, 6)
    indexed, name = exact_dedup.index(heads, table, depth)
    assert depth and indexed.select("bucket").distinct().count() > 4
    plan = indexed.groupBy("bucket", "key").agg(exact_dedup.F.sum("size"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql(f"DROP TABLE {name}")
