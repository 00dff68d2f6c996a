"""What several operators of this subpackage need: shared scratch tables, text batches as byte buffers, hashing.

Nulls, ties, empties: a null text is an empty one in every batch; equal rows stay apart in stored tables; an empty table is stored with
its schema and read back with no rows; column names are compared without regard to case where a name must be free.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that contracts name: space and 0x09-0x0D.
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); one is set only where none is, and only in local
    mode, where a folder of this machine is shared by all tasks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tallyforge/{name}-{uuid.uuid4().hex}"


#: Bytes of rows in one Arrow batch, about: what the JVM and a Python worker hold at once follows from it and not from the texts' lengths.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Rows go to Python in batches of bounded bytes from here on, where the session does not ask for smaller ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stored(df: DataFrame, name: str, partition_by: str | None = None, codec: str = "snappy") -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends here and sizes are known to the planner."""
    spark = df.sparkSession
    bounded(spark)
    path = scratch(spark, name)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more."""
    jvm = spark._jvm
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file)
            while "-" not in path.getName() or path.getParent().getName() != "tallyforge":
                path = path.getParent()
                if path is None or path.isRoot():
                    break
            else:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df is called so in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and n+1 offsets; null is empty. No Python strings are made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, a long row alone: what is worked on at once stays small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the public fmix64 steps); x is changed in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between batches."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        m = max(n, 1 << 16, 2 * len(have) if have is not None and len(have) < 1 << 24 else 0)
        have = np.full(m, base & (2**64 - 1), np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


#: An odd base of the rolling polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n+1 sums of (byte+1)*BASE**i modulo 2**64; span_hashes() turns differences into hashes that ignore the place."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data.astype(np.uint64) + np.uint64(1), powers(BASE, len(data)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    x = sums[end] - sums[start]
    x *= powers(INVERSE, len(sums))[start]
    x += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(x)


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with inside[byte], which never cross rows; n+1 word counts up to each row."""
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)  # a row starts here
    edge[offsets] = True
    begin = mask.copy()
    begin[1:] &= ~mask[:-1] | edge[1:-1]
    end = mask
    end[:-1] &= ~mask[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


#: Byte tables: lower case for A-Z alone; letters, digits and all of UTF-8's longer forms; all but space and 0x09-0x0D.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
SOLID = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])
