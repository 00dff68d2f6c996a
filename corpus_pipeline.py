"""The corpus pipeline: STAGES in order, each over all rows that the one before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import exact_dedup, minhash, mixing, packing, toxicity
from tallyforge.llm.shared import dropped, scratch, table, text_or_empty, unused


#: Shares of the tokens that mixing is to leave, over the domains that the stages before it leave; toxic documents have gone by then.
TARGETS = {"good": 0.9, "low": 0.1}


def _rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs whose id and text's hash are in chosen (doc_id, row); of rows that are equal in both, one."""
    row = unused(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64(text_or_empty()))
    want = chosen.select(F.col("doc_id").alias("w_id"), F.col("row").alias("w_row"))
    own = keyed.join(want, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col(row) == F.col("w_row")), "left_semi")
    twice = keyed.groupBy("doc_id", row).count().filter("count > 1").select(F.col("doc_id").alias("t_id"), F.col(row).alias("t_row"))
    if not twice.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col(row) == F.col("t_row"))
        own = own.join(twice, same, "left_anti").unionByName(own.join(twice, same, "left_semi").dropDuplicates(["doc_id", row]))
    return own.select(docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic. Null and empty texts score by the intercept; rows with a null or repeated id are scored
    by their own text; an empty table stays empty; all columns are kept, and none but doc_id and text is read."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest id, null last. Rows that share an id but not a
    text go by their texts; of rows equal in id and text one stays; null and empty texts are one group."""
    return _rows(docs, exact_dedup.exact_groups(docs, rows_too=True).filter("chosen").select("doc_id", "row").distinct())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id. A null id stands for a number from 2**62 on that follows
    from its text, so that such rows meet as others do; of rows that share an id and a set one stays, and rows that share an id
    but not a set go by their sets; texts without words stay all."""
    stand_in = F.lit(2**62) + F.pmod(F.xxhash64(text_or_empty()), F.lit(2**61))
    rows = docs.select(F.coalesce("doc_id", stand_in).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")
    found = minhash.near_groups(rows, rows_too=True).filter("kept")
    empty = F.when(F.col("n_shingles") == 0, F.col("row"))
    one = found.groupBy("doc_id", "set_a", "set_b", empty.alias("e")).agg(F.min("row").alias("row"))
    nulls = docs.filter(F.col("doc_id").isNull()).select(stand_in.alias("doc_id"), F.lit(True).alias("none")).distinct()
    one = one.join(nulls, "doc_id", "left").select(F.when(F.col("none").isNull(), F.col("doc_id")).alias("doc_id"), "row")
    return _rows(docs, one.distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at rates of at most one, so that none is repeated: a domain is cut to its share in TARGETS of all tokens, and one that
    has fewer is kept whole and shrinks no other. Null and empty texts have no tokens and stay or go by their rate; an empty table stays empty."""
    return mixing.mixed_rows(docs, table(spark, sf_dir, "labels"), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence. Null and empty texts pack as their end id, a null source is a queue of its
    own, rows with a null or repeated id are packed each, an empty table gives no rows."""
    pieces = packing.packed(docs)
    return pieces.select("doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", F.crc32("ids").alias("ids_crc32"))


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_exact_copies), ("MinHash near-dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: The model stages and the tokenizer cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read by the next."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = scratch(spark, f"stage-{stage.__name__}")
        out.write.parquet(path)
        if read is not None:
            dropped(spark, read)
        docs = read = spark.read.parquet(path)
    return docs
