"""Sharding by a permutation-filled lookup table, in DataFrame functions.

Each shard has a permutation of the slots of a prime-sized table, given by an offset and a step from digests of its name.
The shards take turns; in its turn a shard claims the first slot of its permutation that is still free.  A key belongs to
the slot of its hash: one lookup, and a shard that leaves moves few keys of the others.

The table depends on the shards alone.  Its entries are one literal of two bytes a slot, read into a table of ``size``
rows that is broadcast, so its size is known beforehand (65,537 rows by default) and rows stay where they are.

Null keys have a slot as other keys do; equal keys share a slot; all columns are kept (a column named ``slot`` or
``shard`` is replaced); an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Slots of the table: a prime, well above a hundred times the shards, and small enough to broadcast anywhere.
SLOTS = 65_537
MOST_SLOTS = 10_000_000


def permutation(name: str, size: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8]) % size, int.from_bytes(digest[8:16]) % (size - 1) + 1


def filled(names: Sequence[str], size: int = SLOTS) -> list[int]:
    """Number of the shard that holds each slot."""
    if not names or len(set(names)) != len(names) or len(names) > min(size, 1 << 16):
        raise ValueError("shards need different names, at least one and no more than slots or 65,536")
    if size < 3 or size > MOST_SLOTS or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime from 3 to {MOST_SLOTS}")
    state = [permutation(name, size) for name in names]
    at, step = [a for a, _ in state], [b for _, b in state]
    table, left = [-1] * size, size
    while True:
        for shard in range(len(names)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % size
            table[at[shard]] = shard
            left -= 1
            if not left:
                return table


def lookup_table(spark: SparkSession, names: Sequence[str], size: int = SLOTS) -> DataFrame:
    """Rows (slot, shard)."""
    entries = F.lit(b"".join(shard.to_bytes(2) for shard in filled(names, size)))
    two = F.substring(entries, (F.col("id") * 2 + 1).cast("int"), F.lit(2))
    return spark.range(size).select(F.col("id").alias("slot"), F.conv(F.hex(two), 16, 10).cast("int").alias("shard"))


def placed(df: DataFrame, key_col: str, names: Sequence[str], size: int = SLOTS) -> DataFrame:
    """``df`` with the slot and the shard of each row's key."""
    table = F.broadcast(lookup_table(df.sparkSession, names, size))
    return (df.drop("shard").withColumn("slot", F.pmod(F.xxhash64(df[key_col]), F.lit(size)).cast("long"))
            .join(table, "slot").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard"))
