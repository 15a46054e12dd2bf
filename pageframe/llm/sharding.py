"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: a start and a step that come from its
name, which visit each slot once. The shards take turns, each claiming its next preferred slot that is free, until
the table is full; so each has a like number of slots, and adding or removing a shard moves few others. A key's slot
is its hash modulo the size. The table has a fixed size that depends on no data; it is broadcast, and placing a row
takes one lookup. Only DataFrame functions touch rows.

Defined cases: a null key is placed in a slot like any other (that of its hash); equal keys and repeated rows share a
shard; an empty table gives an empty result; shard names must differ and there must be at least one; other columns are
kept, but columns named ``slot`` and ``shard`` are replaced, unless other names are given for the new ones.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.llm import common

#: Slots: a prime well over a hundred times the shards, so that shares differ by about one in a hundred.
SIZE = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> list[int]:
    """The shard number in every slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    starts, steps = [], []
    for name in shards:
        made = hashlib.blake2b(name.encode(), digest_size=16).digest()
        starts.append(int.from_bytes(made[:8], "big") % size)
        steps.append(int.from_bytes(made[8:], "big") % (size - 1) + 1)
    table, at, free = [-1] * size, starts, size
    while free:
        for shard, step in enumerate(steps):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + step) % size
            table[slot], at[shard] = shard, (slot + step) % size
            free -= 1
            if not free:
                break
    return table


def table_rows(spark: SparkSession, table: list[int]) -> DataFrame:
    """(slot, shard) of a lookup table, made on the JVM."""
    held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    return spark.range(len(table), numPartitions=1).select(F.col("id").cast("int").alias("slot"), F.get(held, F.col("id").cast("int")).alias("shard"))


def slot_of(key: Column, size: int = SIZE) -> Column:
    """Slot of a key: the first 60 bits of its MD5, modulo the size."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def placed(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the slot and shard of its key, in columns of those names; a key that has one of them is read before it is replaced."""
    at, to = common.free_names(df, 2)
    rows = table_rows(df.sparkSession, lookup_table(shards, size)).toDF(at, to)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot, shard)]
    return df.withColumn(at, slot_of(F.col(f"`{key}`"), size)).join(F.broadcast(rows), at).select(*kept, F.col(at).alias(slot), F.col(to).alias(shard))  # `size` rows


def placements(docs: DataFrame) -> DataFrame:
    """What the corpus query returns: every document's slot and shard."""
    return placed(docs.select("doc_id"), "doc_id")
