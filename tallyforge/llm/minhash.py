"""MinHash near-dedup with SetSketch registers.

A text is lower-cased (A-Z) and split at the characters 0x20 and 0x09-0x0D; its set holds its distinct five-word
shingles (fewer words: the whole sequence as one; no words: empty, linked with nothing). A sketch has REGISTERS
registers, each an exponentially spaced, truncated minimum: the smallest of the set's exponential hash values x becomes
floor(1 - log_B(x)), held within 0 and TOP. Sketches merge by taking larger registers, and equal registers are as
likely as the sets are similar, so ROWS registers together make a band's key.

1. Equal sets become one class, with its smallest doc_id (copies are combined on the map side, never paired).
2. Classes that share a band's key are candidates. In each bucket the class that meets most others in all its buckets (an
   original rather than one of its edited copies) is the pivot and is compared with every other, which is linear in the bucket.
   Pairs whose sizes rule a link out end at once; the others' similarity is estimated from both sketches and sizes by
   maximum likelihood, and clearly dissimilar pairs (MARGIN below the threshold, over five standard errors) end there.
3. What is left is confirmed or refused on the full sets. A pivot's set is sent once for a block of partners, not once a pair.
4. Components of the links are found (components.py). A bucket whose members are in one component is done. In the others,
   the component with most members is the hub; its members are not compared with one another, only with the others, and the others
   among themselves. Buckets with the same hub are one place, where a member stands once, if that is less work than each bucket
   by itself. In a place pairs of blocks of members meet, first by sizes and signs of the registers (two bits each), which tells
   the members that have a likely partner in another component, then by full sets, as products of 0/1 matrices. Neither step
   yields pairs: the first yields members, the second the components that it joins. Every pair of a bucket that could join two
   components is checked. A member is sent once for each block that it meets: once a place for a hub's member while the others fit
   a block. Work grows with members times others, and with the square of a bucket only where thousands of different texts
   lie just below the threshold.

A pair at similarity s has no band in common with probability (1 - s**4)**32: 5e-6 at 0.75, less above. Signs refuse a pair
at 0.75 with probability 1e-7 (they are 5.2 standard errors below what is expected there). Shingles are compared by 64-bit hashes.

Nulls, ties, empties: null text is empty; a repeated row is in its copy's component; rows that share an id but not a set go by their sets;
a null id is never a component's smallest and keeps its row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.components import components
from tallyforge.llm.shared import LOWER, SOLID, buffers, dropped, mixed, prefix_sums, slices, span_hashes, stored, text_or_empty, words_of

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: The registers' base, the largest register and the rate of the exponential values.
B, TOP, RATE = 1.001, 65_534, 20.0
MARGIN = 0.2
#: Signs (two bits of each register) that a pair at the threshold may differ in: of 128, 24 are expected, with a deviation of 4.4.
MOST_SIGNS = 47
#: Members in a block that compares signs; shingles in a block that compares sets, and what a member counts besides its own (a
#: block has about SETS_BLOCK / LIGHTEST members at most); columns of a 0/1 matrix.
SIGNS_BLOCK, SETS_BLOCK, LIGHTEST, COLUMNS = 2048, 400_000, 800, 4096

_RNG = np.random.default_rng(20_240_611)
_MULTIPLY = _RNG.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the rows' shingles, repeats included, and n+1 counts up to each row."""
    data = LOWER[data]
    starts, ends, upto = words_of(data, offsets, SOLID)
    word = span_hashes(prefix_sums(data), starts, ends)
    n = np.diff(upto)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(upto[:-1] - to[:-1], count) + np.arange(to[-1])  # the first word of each shingle
    length = np.repeat(np.minimum(n, WORDS), count)
    out = length.astype(np.uint64)
    for k in range(WORDS):
        more = k < length
        at = np.where(more, first + k, 0)
        out = np.where(more, out * np.uint64(0x9E3779B97F4A7C15) + word[at], out) if len(word) else out
    return mixed(out), to


def registers(hashes: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Rows x REGISTERS; a row without shingles has zeros."""
    full = np.flatnonzero(np.diff(to))
    out = np.zeros((len(to) - 1, REGISTERS), np.uint16)
    if not len(full):
        return out
    low, starts = hashes.astype(np.uint32), to[:-1][full]
    least = np.empty((len(full), REGISTERS))
    for j in range(REGISTERS):
        least[:, j] = np.minimum.reduceat(low * _MULTIPLY[j] + _ADD[j], starts)
    x = -np.log1p(-(least + 0.5) / 2**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP).astype(np.uint16)
    return out


def signs(rows: np.ndarray) -> np.ndarray:
    """Rows x 32 bytes: the last two bits of each register; equal registers have equal signs, others have with probability 1/4."""
    two = (rows & 3).astype(np.uint8).reshape(len(rows), -1, 4)
    return two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text as it is), n_shingles, set_a and set_b (128 bits that stand for the set), sketch (little-endian
    uint16 registers), sign (two bits of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for i, j in slices(offsets, 1 << 20):
                h, to = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sets = [np.unique(h[s:e]) for s, e in zip(to[:-1], to[1:], strict=True)]
                with np.errstate(over="ignore"):
                    a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    b = np.array([mixed(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                rows = registers(h, to)
                yield pa.record_batch(
                    [batch["doc_id"].slice(i, j - i), batch["row"].slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary()), pa.array([s.tobytes() for s in signs(rows)], pa.binary())],
                    ["doc_id", "row", "n_shingles", "set_a", "set_b", "sketch", "sign"],
                )

    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("row"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, n_shingles long, set_a long, set_b long, sketch binary, sign binary")


def bands(classes: DataFrame) -> DataFrame:
    """bucket (a band's key) and id, a row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        for batch in batches:
            if len(batch):
                data, _ = buffers(batch["sketch"])
                key = np.tile(seeds, (len(batch), 1))
                parts = data.view("<u2").reshape(len(batch), BANDS, ROWS).astype(np.uint64)
                for k in range(ROWS):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
                yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch["id"].to_numpy(zero_copy_only=False), BANDS), pa.int64())], ["bucket", "id"])

    return classes.select("id", "sketch").mapInArrow(run, "bucket long, id long")


def likely(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarities from registers (pairs x REGISTERS) and set sizes, on a grid of 0.01."""
    more, less = (left > right).sum(1)[:, None], (left < right).sum(1)[:, None]
    u, v = (n / (n + m))[:, None], (m / (n + m))[:, None]
    grid = np.linspace(0, 1, 101)[None, :]
    j = grid * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B), 1e-12, 1)

    up, down = p(u - v * j), p(v - u * j)
    score = more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


@F.arrow_udf(T.DoubleType())
def estimated(left: pa.Array, right: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    if not len(left):
        return pa.array([], pa.float64())
    x, y = (buffers(c)[0].view("<u2").reshape(-1, REGISTERS) for c in (left, right))
    sizes = [c.to_numpy(zero_copy_only=False).astype(float) for c in (n, m)]
    return pa.array(np.concatenate([likely(x[i : i + 2000], y[i : i + 2000], *(s[i : i + 2000] for s in sizes)) for i in range(0, len(x), 2000)]))


def alike_in_size(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can reach the threshold at all: the smaller one would have to lie within the larger."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and its whole set (sorted little-endian uint64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for i, j in slices(offsets, 1 << 20):
                h, to = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sets = [np.unique(h[s:e]).astype("<u8").tobytes() for s, e in zip(to[:-1], to[1:], strict=True)]
                yield pa.record_batch([batch["doc_id"].slice(i, j - i), pa.array(sets, pa.binary())], ["id", "whole"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    sets = rows.join(ids.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi").mapInArrow(run, "id long, whole binary")
    return sets


class Block:
    """Members of one block: ids, components and sets."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.ids, self.roots = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("id", "root"))
        data, ends = zip(*(buffers(p["whole"]) for p in parts), strict=True)
        self.values = np.concatenate(data).view("<u8")
        self.sizes = np.concatenate([np.diff(e) for e in ends]) // 8
        self.row = np.repeat(np.arange(len(self.ids)), self.sizes)


def matches(a: Block, b: Block) -> np.ndarray:
    """len(a) x len(b): whether the full sets reach the threshold, in whole numbers."""
    own = np.unique(b.values) if a is not b else None
    words = np.unique(a.values) if own is None else np.intersect1d(np.unique(a.values), own, assume_unique=True)
    both = np.zeros((len(a.ids), len(b.ids)), np.int64)
    sides = []
    for x in (a, b):
        at = np.searchsorted(words, x.values)
        at[at == len(words)] = 0
        hit = words[at] == x.values if len(words) else np.zeros(0, bool)
        at, row = (at[hit], x.row[hit]) if len(words) else (at[:0], x.row[:0])
        order = np.argsort(at, kind="stable")
        sides.append((at[order], row[order]))
    for lo in range(0, len(words), COLUMNS):  # products of 0/1 matrices count what is common; exact in float32
        dense = []
        for (at, row), x in zip(sides, (a, b), strict=True):
            s, e = np.searchsorted(at, [lo, lo + COLUMNS])
            m = np.zeros((len(x.ids), min(COLUMNS, len(words) - lo)), np.float32)
            m[row[s:e], at[s:e] - lo] = 1
            dense.append(m)
        both += (dense[0] @ dense[1].T).astype(np.int64)
    return 100 * both >= PERCENT * (a.sizes[:, None] + b.sizes[None, :] - both)


def joined(a: Block, b: Block, label: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Pairs of components that links between the blocks join, each join once: label is a union-find over components."""

    def top(x: int) -> int:
        while (y := label.setdefault(x, x)) != x:
            label[x] = label[y]
            x = y
        return x

    linked = None
    while True:
        x, y = (np.array([top(int(r)) for r in block.roots]) for block in (a, b))
        apart = x[:, None] != y[None, :]
        if not apart.any():
            return
        linked = matches(a, b) if linked is None else linked
        apart &= linked
        rows = np.flatnonzero(apart.any(1))
        if not len(rows):
            return
        for u, v in zip(x[rows].tolist(), y[apart[rows].argmax(1)].tolist(), strict=True):
            u, v = top(u), top(v)
            if u != v:
                label[max(u, v)] = min(u, v)
                yield u, v


def confirmed(rows: DataFrame) -> DataFrame:
    """a, b: components that links between members of a group join. rows: g, side, id, root, whole, a row for each member of a group; those of
    side 0 meet those of side 1 and, in a group without a side 1, one another. Side 0 of a group is held in memory, the
    other passes by in batches, so that what a task holds is bounded by how groups are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, left, label, alone = None, [], None, {}, True
        found: list[tuple[int, int]] = []

        def ended() -> None:
            if held and alone:
                block = Block(held)
                found.extend(joined(block, block, label))

        for batch in batches:
            if not len(batch):
                continue
            g, side = (batch[c].to_numpy() for c in ("g", "side"))
            cuts = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (side[1:] != side[:-1])) + 1, [len(g)]])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if g[s] != at:
                    ended()
                    at, held, left, label, alone = g[s], [], None, {}, True
                if not side[s]:
                    held.append(batch.slice(s, e - s))
                    continue
                alone = False
                if held:
                    left = Block(held) if left is None else left
                    found.extend(joined(left, Block([batch.slice(s, e - s)]), label))
            if len(found) >= 1000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
                found = []
        ended()
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return rows.select("g", "side", "id", "root", "whole").repartition("g").sortWithinPartitions("g", "side", "id").mapInArrow(run, "a long, b long")


def open_buckets(members: DataFrame) -> DataFrame:
    """members (bucket, id, root, n) of buckets that hold several components, with hub (the bucket's component with most members, of
    several the smallest) and pairs (of those outside the hub with any member, about)."""
    size = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    most = F.max(F.struct("size", (F.lit(-1) - F.col("root")).alias("order"))).alias("m")
    size = size.groupBy("bucket").agg(most, F.sum("size").alias("of")).filter("m.size < of")
    pairs = (F.col("of") - F.col("m.size")).cast("double") * F.col("of")
    return members.join(size.select("bucket", (F.lit(-1) - F.col("m.order")).alias("hub"), pairs.alias("pairs")), "bucket")


def places(members: DataFrame) -> DataFrame:
    """place, hub, id, root, n of members (open_buckets). place: all buckets of a hub, a member once, where that makes no more pairs
    than its buckets make in all; else the bucket."""
    apart = members.select("bucket", "hub", "pairs").distinct().groupBy("hub").agg(F.sum("pairs").alias("apart"))
    whole = members.select("hub", "id", "root").distinct().groupBy("hub").agg(F.count_if(F.col("root") != F.col("hub")).alias("others"), F.count(F.lit(1)).alias("of"))
    one = whole.join(apart, "hub").select("hub", (F.col("others").cast("double") * F.col("of") <= F.col("apart")).alias("one"))
    place = F.when(F.col("one"), F.col("hub")).otherwise(F.col("bucket")).alias("place")
    return members.join(one, "hub").select(place, "hub", "id", "root", "n").distinct()


def dealt(members: DataFrame, weight: Column, most: int) -> DataFrame:
    """members (place, hub, id, root, ...), dealt out as pairs of blocks that hold about `most` of the weight each: adds g, side. The hub's
    blocks meet those of the others, which also meet one another; one that meets itself is a group without a side 1."""
    own = F.col("root") == F.col("hub")
    blocks = lambda of: F.ceil(F.sum(F.when(of, weight).otherwise(0)) / F.lit(most)).cast("int")
    sizes = members.groupBy("place", "hub").agg(blocks(own).alias("first"), F.greatest(blocks(~own), F.lit(1)).alias("rest"))
    rows = members.join(sizes, ["place", "hub"])
    spread = F.xxhash64(F.lit(5), "id")
    rows = rows.withColumn("own", F.when(own, F.pmod(spread, "first")).otherwise(F.col("first") + F.pmod(spread, "rest")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(own, F.col("first")).otherwise(0), F.col("first") + F.col("rest") - 1)))
    g = F.xxhash64("place", "hub", F.least("own", "other"), F.greatest("own", "other"))
    return rows.withColumn("g", g).withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("first", "rest", "own", "other")


def plausible(members: DataFrame) -> DataFrame:
    """place, hub, id of members (place, hub, id, root, n, sign) that meet, in their place, one of another component that could be a
    link by its size and by the share of equal register signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def ended() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held)
            if len(t) < 2:
                return
            side, ids, root, n = (t[c].to_numpy() for c in ("side", "id", "root", "n"))
            sign = buffers(t["sign"])[0].view("<u8").reshape(len(t), -1)
            right = np.flatnonzero(side == 1) if side[-1] else np.arange(len(t))
            left = np.flatnonzero(side == 0)
            good = np.zeros(len(t), bool)
            for lo in range(0, len(left), 128):
                x = left[lo : lo + 128]
                ok = (root[x][:, None] != root[right][None, :]) & (100 * np.minimum(n[x][:, None], n[right][None, :]) >= PERCENT * np.maximum(n[x][:, None], n[right][None, :]))
                i, j = np.nonzero(ok)
                differ = sign[x[i]] ^ sign[right[j]]
                differ = np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64)
                hit = differ <= MOST_SIGNS
                good[x[i[hit]]] = True
                good[right[j[hit]]] = True
            if good.any():
                place, hub = (t[c].combine_chunks().take(pa.array(np.flatnonzero(good))) for c in ("place", "hub"))
                yield pa.record_batch([place, hub, pa.array(ids[good])], ["place", "hub", "id"])

        for batch in batches:
            if not len(batch):
                continue
            g = batch["g"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if g[s] != at:
                    yield from ended()
                    at, held = g[s], []
                held.append(batch.slice(s, e - s))
        yield from ended()

    rows = dealt(members, F.lit(1), SIGNS_BLOCK)
    rows = rows.select("g", "side", "place", "hub", "id", "root", "n", "sign").repartition("g").sortWithinPartitions("g", "side", "id")
    return rows.mapInArrow(run, "place long, hub long, id long").distinct()


def near_groups(docs: DataFrame, rows_too: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; with rows_too also row, set_a and set_b, which tell apart the
    rows of an id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sketch = stored(sketches(docs), "near-sketches")
    best = F.min(F.struct("doc_id", "sketch", "sign")).alias("best")
    classes = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n_shingles").agg(best)
    classes = stored(classes.select("set_a", "set_b", F.col("n_shingles").alias("n"), F.col("best.doc_id").alias("id"), F.col("best.sketch").alias("sketch"), F.col("best.sign").alias("sign")), "near-classes")
    own = ["row"] if rows_too else []
    rows = stored(sketch.select("doc_id", *own, "n_shingles", "set_a", "set_b"), "near-rows")
    dropped(spark, sketch)

    every = stored(bands(classes), "near-bands")
    crowded = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("company"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("mark"))
    crowded = stored(crowded.filter("company > 1 AND low < high"), "near-buckets")
    member = stored(every.join(crowded.select("bucket", "company"), "bucket"), "near-crowded")
    dropped(spark, every)
    central = member.groupBy("id").agg(F.sum("company").alias("company"))  # how many a class meets in all its buckets
    known = stored(classes.select("id", "n", "sketch", "sign").join(central, "id"), "near-known")
    once = crowded.groupBy("company", "low", "high", "mark").agg(F.min("bucket").alias("bucket"))  # the same members in another band add nothing
    own = member.select("bucket", "id").join(once.select("bucket"), "bucket", "left_semi").join(known.select("id", "n", "company"), "id")
    own = stored(own, "near-members")
    dropped(spark, member, crowded)
    order = F.max(F.struct("company", (F.lit(-1) - F.col("id")).alias("order"), "n")).alias("p")
    pivots = own.groupBy("bucket").agg(order).select("bucket", (F.lit(-1) - F.col("p.order")).alias("pivot"), F.col("p.n").alias("m"))
    met = stored(own.select("bucket", "id", "n").join(pivots, "bucket").filter("id != pivot"), "near-met")
    dropped(spark, own)

    # every class against its buckets' pivots
    star = met.filter(alike_in_size(F.col("n"), F.col("m"))).select("pivot", "id", "n").distinct()
    side = lambda x: known.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"k_{x}"))
    guess = star.join(side("pivot"), "pivot").join(side("id"), "id").withColumn("s", estimated("k_pivot", "k_id", "n_pivot", "n_id"))
    likely_pairs = stored(guess.filter(F.col("s") >= PERCENT / 100 - MARGIN).select("pivot", "id", "n"), "near-likely")
    ids = likely_pairs.select("id").unionByName(likely_pairs.select(F.col("pivot").alias("id"))).distinct()
    sets = stored(full_sets(docs, ids), "near-sets")
    blocks = likely_pairs.groupBy("pivot").agg(F.ceil(F.sum(F.col("n") + LIGHTEST) / F.lit(SETS_BLOCK)).alias("blocks"))
    guess = stored(likely_pairs.join(blocks, "pivot").select("pivot", "id", F.xxhash64("pivot", F.pmod(F.xxhash64(F.lit(7), "id"), "blocks")).alias("g")), "near-dealt")
    sides = guess.select("g", F.col("pivot").alias("id"), F.lit(0).alias("side")).distinct().unionByName(guess.select("g", "id", F.lit(1).alias("side")))
    links = stored(confirmed(sides.join(sets, "id").withColumn("root", F.col("id"))), "near-links")
    dropped(spark, likely_pairs, guess)
    root = components(links)

    # buckets whose members are not in one component: all pairs that could join two
    left = met.select("bucket", "id", "n").join(root.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("root"))
    left = stored(open_buckets(left), "near-apart")
    members = stored(places(left).join(known.select("id", "sign"), "id"), "near-open")
    dropped(spark, met, known, left)
    held = stored(plausible(members), "near-plausible")
    missing = held.select("id").distinct().join(sets.select("id"), "id", "left_anti")
    more = stored(full_sets(docs, missing), "near-more")
    pairs = dealt(held.join(members.drop("sign"), ["place", "hub", "id"]), F.lit(LIGHTEST) + F.col("n"), SETS_BLOCK)
    later = stored(confirmed(pairs.select("g", "side", "id", "root").join(sets.unionByName(more), "id")), "near-later")
    dropped(spark, members, held, sets, more)
    root = components(links.unionByName(later))
    dropped(spark, links, later)

    of_class = classes.select("set_a", "set_b", F.col("n").alias("n_shingles"), "id").join(root.withColumnRenamed("node", "id"), "id", "left")
    of_class = of_class.select("set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("root"))
    out = rows.join(of_class, ["set_a", "set_b", "n_shingles"], "left")
    own = ["row", "set_a", "set_b"] if rows_too else []
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("root", "doc_id")).alias("kept"), *own)
