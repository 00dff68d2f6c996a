"""Exact dedup [native]: an extendible-hash index on shared files.

Every text, without the characters of `[\\x20\\x09-\\x0D]`, gets a 64-bit key and a digest. Copies are combined on the map side to
one entry for each key and digest, so that a group of any size costs one row a task. A directory over the key's leading bits
starts with one bucket; while a bucket holds more entries than its capacity, it splits, and the directory doubles when that
bucket already used all of its bits. The entries are written to the shared folder as a table bucketed by the directory's
buckets and sorted by key, so that a bucket's entries lie in one file (a full bucket of one key goes on in it: an overflow chain).

The owner of a bucket reads its own file, without a shuffle of the index, and chains the entries of a key; the keys whose
chain has more than one document are its collisions. The texts of those documents alone are fetched and compared by bytes: rows are
grouped by bucket, key AND the whole text, copies again combined on the map side. The compared groups go to the owners, which
settle each entry of the chain from them. The last join, of documents with settled groups, is a plain equi-join, which the planner may split.

Nulls, ties, empties: null text counts as empty; empty and white-space-only texts are copies of one another. Of equal
texts the one with the most code points stays, then the smallest doc_id; a null doc_id comes after all others. Repeated rows
are documents of their own. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import SPACE, dropped, scratch, stored, text_or_empty

#: Entries in a bucket before it splits, and the most bits of the directory (its size is bounded by 2**MOST_BITS).
CAPACITY, MOST_BITS = 100_000, 18


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(col), f"{SPACE}+", "")


def directory(cells: dict[int, int], bits: int, capacity: int) -> tuple[list[int], int]:
    """The directory (slot -> bucket) and its depth, from counts by the key's first `bits` bits.

    A bucket splits while it is overfull and wider than one cell; the global depth, and with it the directory's length
    2**depth, is the largest local depth.
    """
    upto = [0] * ((1 << bits) + 1)
    for cell, n in cells.items():
        upto[cell + 1] = n
    for i in range(1 << bits):
        upto[i + 1] += upto[i]
    leaves, todo = [], [(0, 0)]
    while todo:
        first, depth = todo.pop()
        width = 1 << (bits - depth)
        if depth < bits and upto[first + width] - upto[first] > capacity:
            todo += [(first, depth + 1), (first + width // 2, depth + 1)]
        else:
            leaves.append((first, depth))
    most = max(depth for _, depth in leaves)
    slots = [number for number, (_, depth) in enumerate(sorted(leaves)) for _ in range(1 << (most - depth))]
    return slots, most


def entries(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text as it is), n_points, key, digest: a row for each document, without its text."""
    text = text_or_empty()
    rows = docs.select("doc_id", F.xxhash64(text).alias("row"), F.length(text).alias("n_points"), normalised().alias("norm"))
    return rows.select("doc_id", "row", "n_points", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("digest"))


def best() -> Column:
    """Of some rows the one that stays: most code points, smallest doc_id, null last."""
    order = F.coalesce(F.lit(-1) - F.col("doc_id"), F.lit(-(2**63)))  # does not overflow
    return F.max(F.struct("n_points", order.alias("order"), "doc_id", "row")).alias("best")


def lookup(heads: DataFrame, capacity: int, bits: int) -> tuple[DataFrame, int]:
    """The directory as a table of slot and bucket (2**depth rows), and its depth."""
    cell = F.shiftrightunsigned("key", 64 - bits)
    cells = {r[0]: r[1] for r in heads.groupBy(cell.alias("cell")).count().toLocalIterator()}  # at most 2**bits counts
    slots, depth = directory(cells, bits, capacity)
    table = heads.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, slots))), ",").cast("array<int>")).alias("slot", "bucket"))
    return table, depth


def bucket_of(rows: DataFrame, table: DataFrame, depth: int) -> DataFrame:
    """rows with the bucket of their key. The directory's size is bounded by 2**MOST_BITS."""
    if not depth:
        return rows.withColumn("bucket", F.lit(0))
    return rows.withColumn("slot", F.shiftrightunsigned("key", 64 - depth)).join(F.broadcast(table), "slot").drop("slot")


def index(heads: DataFrame, table: DataFrame, depth: int) -> tuple[DataFrame, str]:
    """The index as a bucketed table on shared files, and its name in the catalog."""
    spark = heads.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "exact-index")
    name = "exact_index_" + path.rsplit("-", 1)[-1]
    placed = bucket_of(heads, table, depth).repartition(owners, "bucket")
    placed.write.format("parquet").option("path", path).bucketBy(owners, "bucket").sortBy("bucket", "key", "digest").saveAsTable(name)
    return spark.table(name), name


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, bits: int = MOST_BITS, rows_too: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; with rows_too also row, and chosen, which is true for one
    row of each group (or several that are equal in id and text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    flat = stored(entries(docs), "exact-entries")
    heads = stored(flat.groupBy("key", "digest").agg(best(), F.count(F.lit(1)).alias("size")), "exact-heads")
    table, depth = lookup(heads, capacity, bits)
    indexed, name = index(heads, table, depth)
    dropped(spark, heads)
    collisions = indexed.groupBy("bucket", "key").agg(F.sum("size").alias("n")).filter("n > 1").select("key")
    text = text_or_empty()
    texts = docs.select("doc_id", F.xxhash64(text).alias("row"), F.length(text).alias("n_points"), normalised().alias("norm")).withColumn("key", F.xxhash64("norm"))
    texts = bucket_of(texts.join(stored(collisions, "exact-keys"), "key", "left_semi"), table, depth)
    compared = texts.groupBy("bucket", "key", "norm").agg(best().alias("of_bytes"), F.count(F.lit(1)).alias("n")).select("bucket", "key", F.unhex(F.sha2("norm", 256)).alias("digest"), "of_bytes", "n")
    settled = stored(indexed.select("bucket", "key", "digest").join(stored(compared, "exact-compared"), ["bucket", "key", "digest"]).select("key", "digest", F.col("of_bytes").alias("best"), F.col("n").alias("size")), "exact-settled")
    files = indexed.select("key")
    spark.sql(f"DROP TABLE {name}")
    dropped(spark, files)
    out = flat.join(settled, ["key", "digest"], "left")
    alone = F.col("size").isNull()
    more = ["row", (alone | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == F.col("best.row")))).alias("chosen")] if rows_too else []
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("best.doc_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *more,
    )
