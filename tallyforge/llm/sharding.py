"""Sharding: a permutation-filled lookup table.

Every shard has a preference order over a table of prime size: offset + k * skip modulo the size, which visits every slot once
because the size is prime. The shards take turns, each claiming its first free preference, until the table is full: shares
differ by a slot at most, and when a shard leaves, nearly all other slots keep their shard. The table (SIZE
entries, fixed) is broadcast; a key's slot is its hash modulo the size, so that placement takes constant time and no shuffle.

Nulls, ties, empties: a null key is placed like any other value, always in the same shard; repeated rows share a shard; names must be
distinct and fewer than the size; an empty table gives no rows; all columns are kept,
but those called slot or shard in any case, which are replaced; a shard's name may hold any characters.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import unused

#: A prime, over a hundred slots for each of up to 655 shards.
SIZE = 65_537


def lookup(shards: list[str], size: int = SIZE) -> list[int]:
    """Slot -> number of the shard in `shards`; the same for any order of the same names, but for the numbers."""
    if not shards or len(set(shards)) != len(shards) or len(shards) >= size:
        raise ValueError("shards must be distinct, at least one and fewer than the table's slots")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    orders = []
    for i in turns:
        digest = hashlib.sha256(shards[i].encode()).digest()
        orders.append([int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1])
    table, free = [-1] * size, size
    while free:
        for i, order in zip(turns, orders, strict=True):
            slot, skip = order
            while table[slot] >= 0:
                slot = (slot + skip) % size
            table[slot] = i
            order[0] = (slot + skip) % size
            free -= 1
            if not free:
                break
    return table


def placed(rows: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """rows with slot and shard."""
    table = lookup(shards, size)
    names = F.array(*[F.lit(x) for x in shards])
    numbers = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    entries = rows.sparkSession.range(1).select(F.posexplode(numbers).alias("slot", "n")).select("slot", F.element_at(names, F.col("n") + 1).alias("shard"))
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0null"))), F.lit(size)).cast("int")
    others = [c for c in rows.columns if c.lower() not in ("slot", "shard")]
    at = unused(rows, "at")
    keyed = rows.withColumn(at, slot).select(*others, F.col(at).alias("slot"))
    return keyed.join(F.broadcast(entries), "slot").select(*others, "slot", "shard")
