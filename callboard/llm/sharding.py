"""Placement by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: a start
and a step, both hashed from its name, so the order visits every slot. The shards take turns;
on its turn a shard claims the first slot in its order that is still free. All shards end
with almost the same number of slots, and when a shard leaves or joins, few slots of the
others change hands. A row goes to the shard of the slot that its key hashes to.

The table has ``size`` rows whatever the data, so it is broadcast; placing a row is one
lookup, without a shuffle, and a hot source or host spreads over all shards as long as the
key tells its rows apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callboard.llm.blocks import free_names

#: Slots of the table, a prime: over 200 slots for each of 256 shards.
SIZE = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], size: int = SIZE, weights: Mapping[str, int] | None = None) -> list[str]:
    """The shard of each slot. A shard of weight w takes w turns in a row; weight 0 takes none.

    The order in which shards are given doesn't matter; names must differ.
    """
    names = sorted(shards)
    if not _prime(size):
        raise ValueError(f"the table's size must be a prime, not {size}")
    if len(set(names)) != len(names):
        raise ValueError("shard names must differ")
    turns = [n for n in names for _ in range((weights or {}).get(n, 1))]
    if not turns or len(turns) > size:
        raise ValueError(f"{len(turns)} turns in a round for {size} slots")
    at = {n: _number(f"start/{n}") % size for n in names}
    step = {n: _number(f"step/{n}") % (size - 1) + 1 for n in names}
    owner: list[str | None] = [None] * size
    free = size
    while free:
        for name in turns[: max(free, 0)] if free < len(turns) else turns:
            slot = at[name]
            while owner[slot] is not None:
                slot = (slot + step[name]) % size
            owner[slot] = name
            at[name] = (slot + step[name]) % size
            free -= 1
    return owner  # type: ignore[return-value]


def table(spark: SparkSession, shards: Sequence[str], size: int = SIZE, weights: Mapping[str, int] | None = None) -> DataFrame:
    """(slot, shard), one row per slot."""
    rows = list(enumerate(fill(shards, size, weights)))
    return spark.createDataFrame(rows, "slot bigint, shard string")


def slot_of(keys: Sequence[str], size: int = SIZE) -> Column:
    """The slot of a row: its key columns as text, hashed. A null differs from any text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("bigint"), F.lit(size))


def place(
    rows: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = SIZE,
    weights: Mapping[str, int] | None = None, slot: str = "slot", shard: str = "shard",
) -> DataFrame:
    """All rows and columns with ``slot`` and ``shard`` (columns of these names are replaced).

    Equal keys go together, so repeated rows do; null keys have a slot of their own; an empty
    table stays empty.
    """
    kept = [F.col(c) for c in rows.columns if c not in (slot, shard)]
    place_, owner = free_names([*rows.columns, slot, shard], "slot_", "shard_")
    owners = table(rows.sparkSession, shards, size, weights).select(F.col("slot").alias(place_), F.col("shard").alias(owner))
    placed = rows.select(*kept, slot_of(keys, size).alias(slot))
    joined = placed.join(F.broadcast(owners), F.col(slot) == F.col(place_))
    return joined.select(*[c for c in placed.columns if c != slot], slot, F.col(owner).alias(shard))


def write(placed: DataFrame, path: str, rows_per_file: int = 1_000_000, shard: str = "shard") -> None:
    """Write one folder per shard, each dealt into files of about ``rows_per_file`` rows.

    Rows are dealt by the hash of all their columns and a random part, so copies of one row
    spread as well; the count per shard is a partial aggregate.
    """
    spark = placed.sparkSession
    counts = placed.groupBy(F.col(shard).alias("_s")).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).alias("_files"))
    dealt = placed.join(F.broadcast(counts), F.col(shard) == F.col("_s"))  # one row per shard
    dealt = dealt.withColumn("_file", F.floor(F.rand(17) * F.col("_files")))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartition(files, shard, "_file").drop("_s", "_files", "_file").write.partitionBy(shard).parquet(path)
