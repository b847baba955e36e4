"""Sharding by a permutation-filled lookup table (Maglev-style consistent hashing).

Every shard has its own permutation of the slots of a table of prime size, from an
offset and a step hashed from its name. Shards take turns; in its turn a shard
claims the first slot of its permutation that is still free, until the table is
full. Every shard thus holds table_size / shards slots, give or take one, and
adding or losing a shard moves few others. The table has table_size rows whatever
the data: it is filled once on the driver and broadcast, and placing a row is one
hash and one lookup, in the JVM, without a shuffle.

Edge cases: rows with a null key are placed by the hash of the fallback column, so
that they spread like any others, and by the empty string if that is null too.
Repeated keys share a shard. Columns of the input with the name of a result are
replaced, others pass through. No rows, no rows placed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that placing may broadcast.
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], table_size: int = 65_537) -> list[int]:
    """Index of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and at least one")
    if not _is_prime(table_size) or table_size < len(shards) or table_size > MOST_SLOTS:
        raise ValueError(f"table_size must be a prime from the number of shards to {MOST_SLOTS}")
    at = [_number(f"{s}|offset") % table_size for s in shards]
    step = [_number(f"{s}|step") % (table_size - 1) + 1 for s in shards]
    table, left = [-1] * table_size, table_size
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % table_size
            table[at[shard]] = shard
            left -= 1
            if not left:
                return table


def table_frame(spark: SparkSession, table: list[int], shards: list[str]) -> DataFrame:
    """(slot, shard) with one row per slot."""
    codes = F.split(F.lit(",".join(map(str, table))), ",")
    names = F.array(*map(F.lit, shards))
    return spark.range(1, numPartitions=1).select(F.posexplode(codes).alias("slot", "code")).select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("code").cast("int") + 1).alias("shard"))


def slot_of(key: F.Column, table_size: int) -> F.Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % table_size


def place(spark: SparkSession, df: DataFrame, key: str, shards: list[str], table_size: int = 65_537, fallback: str | None = None) -> DataFrame:
    """df plus slot and shard."""
    spare = F.md5(F.coalesce(F.col(fallback), F.lit("")).cast("binary")) if fallback else F.lit("")
    named = F.coalesce(F.col(key).cast("string"), spare)
    table = table_frame(spark, lookup_table(shards, table_size), shards)
    return df.drop("slot", "shard").withColumn("slot", slot_of(named, table_size)).join(F.broadcast(table), "slot")


def write_sharded(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write one folder per shard; rows of a shard are dealt evenly over files_per_shard tasks."""
    part = F.pmod(F.col("slot"), F.lit(files_per_shard))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)
