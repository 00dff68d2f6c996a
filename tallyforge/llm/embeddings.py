"""Embedding near-dedup with randomised-rotation binary codes and stored correction factors.

A unit vector o is turned by several random rotations P; its code is the signs of P o and its correction factor, for each
rotation, is <P o, x> with x = sign(P o)/sqrt(D). For another unit vector q, <P q, x> divided by the factor estimates
<o, q> without bias, and the part of x outside of o bounds the error (CONFIDENCE times its standard deviation).

1. Equal vectors become one class with its smallest vec_id and its size: copies are counted, never paired.
2. Slices of the code's bits are the keys of hash tables. Two vectors at the threshold's angle agree in a bit with
   probability 1 - angle/pi; bits and tables are chosen from the number of classes so that a bucket holds about
   BUCKET vectors of no pattern and a pair at the threshold is missed with probability MISS at most, closer ones less.
3. Within a bucket, codes that differ in clearly more bits than the threshold allows (SPREAD standard deviations) are passed over; a
   pair found in several tables counts in the first. Buckets of over BLOCK vectors are dealt out as pairs of blocks.
4. The estimate from one vector and the other's code and factors, with its bound, decides which pairs can be links;
   these alone are computed again exactly, in double precision.

Nulls, ties, empties: a vector that is null, empty, zero, or holds null or non-finite components links with nothing, as does a
null vec_id; vectors of different lengths never link; repeated rows link with each other; an empty table gives no rows; other
columns (labels too) are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.components import components
from tallyforge.llm.shared import buffers, dropped, stored

THRESHOLD, MISS, BUCKET, BLOCK = 0.95, 1e-6, 32, 2048
SPREAD, CONFIDENCE, LEAST_ROTATIONS = 6.0, 6.0, 8


def rotations(dim: int, n: int) -> np.ndarray:
    """n seeded orthogonal dim x dim matrices."""
    rng = np.random.default_rng([dim, 77])
    out = []
    for _ in range(n):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.array(out)


def tables(classes: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits in a key, and how many tables."""
    bits = max(8, min(30, math.ceil(math.log2(max(classes, 1) / BUCKET + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.array(rows, np.float64).reshape(len(rows), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_TURNS: dict[tuple[int, int], np.ndarray] = {}


def turned(x: np.ndarray, need: int) -> np.ndarray:
    """Rows x rotations x dim, with at least `need` components in all."""
    key = x.shape[1], max(LEAST_ROTATIONS, -(-need // x.shape[1]))
    if key not in _TURNS:
        _TURNS[key] = rotations(*key)
    return np.einsum("rij,nj->nri", _TURNS[key], x)


def codes(classes: DataFrame, need: int) -> DataFrame:
    """id, dim, code (packed signs), factors (little-endian float32, one a rotation)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            for own, (rows,) in by_length(batch["embedding"]):
                y = turned(unit(rows), need)
                factor = (np.abs(y).sum(2) / math.sqrt(rows.shape[1])).astype("<f4")
                code = np.packbits(y.reshape(len(own), -1) > 0, axis=1)
                yield pa.record_batch([batch["id"].take(pa.array(own)), pa.array(np.full(len(own), rows.shape[1], np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([f.tobytes() for f in factor], pa.binary())], ["id", "dim", "code", "factors"])

    return classes.select("id", "dim", "embedding").mapInArrow(run, "id long, dim int, code binary, factors binary")


def candidates(code: DataFrame, bits: int, number: int, threshold: float) -> DataFrame:
    """a < b of pairs that share a bucket and whose codes differ in few enough bits."""
    differ = math.acos(threshold) / math.pi

    def keys(c: np.ndarray) -> np.ndarray:
        flat = np.unpackbits(c, axis=1)[:, : bits * number].reshape(len(c), number, bits)
        return flat @ (1 << np.arange(bits, dtype=np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, blobs = (batch[c].to_pylist() for c in ("id", "dim", "code"))
            for dim in sorted(set(dims)):
                own = [i for i, d in enumerate(dims) if d == dim]
                for at in range(0, len(own), 1000):
                    part = own[at : at + 1000]
                    k = keys(np.frombuffer(b"".join(blobs[i] for i in part), np.uint8).reshape(len(part), -1))
                    bucket = (np.arange(number, dtype=np.int64) << 32 | k).reshape(-1)
                    each = np.repeat(np.arange(len(part)), number)
                    yield pa.record_batch([pa.array([ids[i] for i in part], pa.int64()).take(pa.array(each)), pa.array(np.full(len(each), dim, np.int32)), pa.array(bucket), pa.array([blobs[i] for i in part], pa.binary()).take(pa.array(each))], ["id", "dim", "bucket", "code"])

    member = code.mapInArrow(deal, "id long, dim int, bucket long, code binary")
    sizes = member.groupBy("dim", "bucket").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / F.lit(BLOCK)).cast("int")
    member = member.join(sizes, ["dim", "bucket"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("dim", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "code")
    member = member.repartition("dim", "bucket", "lo", "hi").sortWithinPartitions("dim", "bucket", "lo", "hi")

    def pairs_of(key: tuple, ids: np.ndarray, own: np.ndarray, code: np.ndarray) -> Iterator[np.ndarray]:
        _, bucket, lo, hi = key
        table, total = bucket >> 32, code.shape[1] * 8
        most = total * differ + SPREAD * math.sqrt(total * differ * (1 - differ))
        packed = code.view(np.uint64) if code.shape[1] % 8 == 0 else code
        left = np.flatnonzero(own == lo)
        right = left if lo == hi else np.flatnonzero(own == hi)
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            far = np.bitwise_count(packed[rows][:, None, :] ^ packed[right][None, :, :]).sum(2, dtype=np.int32)
            i, j = np.nonzero(far <= most)
            i, j = rows[i], right[j]
            ok = ids[i] < ids[j] if lo == hi else ids[i] != ids[j]
            i, j = i[ok], j[ok]
            if table and len(i):
                used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                k = keys(code[used])[:, :table]
                first = ~(k[back[: len(i)]] == k[back[len(i) :]]).any(1)
                i, j = i[first], j[first]
            if len(i):
                yield np.sort(np.stack([ids[i], ids[j]]), axis=0)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            ids, own, blobs = (np.concatenate([h[k] for h in held]) if k < 2 else sum((h[k] for h in held), []) for k in range(3))
            if len(ids) > 1:
                for pair in pairs_of(at, ids, own, np.frombuffer(b"".join(blobs), np.uint8).reshape(len(ids), -1)):
                    yield pa.record_batch([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "bucket", "lo", "hi")], 1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
            ids, own, blobs = batch["id"].to_numpy(), batch["own"].to_numpy(), batch["code"].to_pylist()
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(int(x) for x in key[s])
                if now != at and held:
                    yield from flush()
                    held = []
                at = now
                held.append((ids[s:e], own[s:e], blobs[s:e]))
        if held:
            yield from flush()

    return member.mapInArrow(meet, "a long, b long")


def by_length(*columns: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row numbers and, for each column of vectors, a matrix, for runs of up to 2000 rows whose vectors have one length."""
    lengths = pc.list_value_length(columns[0]).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        own = np.flatnonzero(lengths == dim)
        for at in range(0, len(own), 2000):
            part = own[at : at + 2000]
            yield part, [c.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) for c in columns]


@F.arrow_udf(T.DoubleType())
def upper_bound(vector: pa.Array, code: pa.Array, factors: pa.Array) -> pa.Array:
    """The largest inner product that the estimate from a vector and another's code and factors allows."""
    out = np.empty(len(vector))
    for part, (rows,) in by_length(vector):
        dim = rows.shape[1]
        f = buffers(factors.take(pa.array(part)))[0].view("<f4").reshape(len(part), -1).astype(float)
        bits = np.unpackbits(buffers(code.take(pa.array(part)))[0].reshape(len(part), -1), axis=1)[:, : f.shape[1] * dim]
        y = turned(unit(rows), f.shape[1] * dim)
        x = (2.0 * bits.reshape(y.shape) - 1) / math.sqrt(dim)
        guess = (np.einsum("nri,nri->nr", y, x) / f).mean(1)
        error = np.sqrt(((1 - f * f).clip(0) / (f * f)).mean(1) / (max(dim - 1, 1) * f.shape[1]))
        out[part] = guess + CONFIDENCE * error
    return pa.array(out)


@F.arrow_udf(T.DoubleType())
def cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """Exact cosines of vectors of equal lengths, in double precision."""
    out = np.empty(len(left))
    for part, (x, y) in by_length(left, right):
        out[part] = np.einsum("ni,ni->n", unit(x), unit(y))
    return pa.array(out)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    ok = F.coalesce(F.size("embedding") > 0, F.lit(False)) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"))
    classes = stored(classes.select("id", "size", F.size("embedding").alias("dim"), "embedding"), "vec-classes")
    bits, number = tables(classes.count(), threshold)
    code = stored(codes(classes, bits * number), "vec-codes")
    pairs = stored(candidates(code.select("id", "dim", "code"), bits, number, threshold), "vec-pairs")

    vector = classes.select("id", "embedding")
    guess = pairs.join(vector.select(F.col("id").alias("a"), F.col("embedding").alias("x")), "a").join(code.select(F.col("id").alias("b"), "code", "factors"), "b")
    guess = guess.filter(upper_bound("x", "code", "factors") >= threshold).select("a", "b", "x").join(vector.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")
    links = stored(guess.filter(cosine("x", "y") >= threshold).select("a", "b").distinct(), "vec-links")

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("id").alias("b"), "size"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("size").alias("others"))
    root = components(links).withColumnRenamed("node", "id")
    dropped(vectors.sparkSession, code, pairs)
    known = classes.select("id", "size", "embedding").join(others, "id", "left").join(root, "id", "left")
    known = known.select("embedding", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("root"))
    valid = F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))
    out = rows.filter(valid).join(known, "embedding").select("vec_id", "n", "root")
    none = F.lit(None).cast("long")
    out = out.unionByName(rows.filter(~valid).select("vec_id", none.alias("n"), none.alias("root")))  # these meet nothing, so they are not joined
    top = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), F.col("vec_id").eqNullSafe(top).alias("kept"))
