"""Connected components by alternating large-star and small-star steps: aggregates and equi-joins only, no driver state.

Edges are first united within bounded chunks of each partition (CHUNK edges, about 10 MB of a task's memory), which leaves a
row a node and chunk. Then each step sends every node's neighbours to the smallest of them; a logarithmic number of rounds leaves
stars. A node of any degree is a row for each edge, never one list. The same steps run at every size.

Nulls, ties, empties: an edge with a null end and one from a node to itself are ignored; repeated and reversed edges count once;
no edges give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import dropped, stored

CHUNK = 100_000


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: each node of a chunk of edges and the smallest that it reaches there."""
    above: dict[int, int] = {}
    n = 0

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, y) for x in above if (y := top(x)) != x]
        return pa.record_batch([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            a, b = top(u), top(v)
            above[max(a, b)] = min(a, b)
            n += 1
            if n == CHUNK:
                yield out()
                above.clear()
                n = 0
    yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge between different nodes."""
    ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    now = stored(ends.mapInArrow(united, "u long, v long").distinct(), "star")
    mark = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    was, state = None, now.agg(*mark).first()
    while state != was and state["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")
        dropped(edges.sparkSession, now)
        now, was, state = after, state, after.agg(*mark).first()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
