"""Connected components of an edge table, by large-star and small-star rounds.

No adjacency list is ever gathered: each round is two aggregations, combined
map-side, and two joins on the vertex. A hub is not dealt to one task: at most
``rows / limit`` vertices can have more than ``limit`` rows, so a bounded table of
these is broadcast and their rows are joined where they are; all other vertices have
few rows each. Rounds grow with the logarithm of the longest path (Kiveris et al.,
"Connected components in MapReduce and beyond").
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import scratch

#: No more than this many hubs are broadcast.
MOST_HUBS = 1000


def with_least(rows: DataFrame, key: str, value: str, n_rows: int, hub_rows: int = 256) -> DataFrame:
    """rows plus m, the least value of their key (null only if no value is known); n_rows: how many rows there are at most."""
    limit = max(hub_rows, n_rows // MOST_HUBS)
    least = rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > limit).select(key, F.col("m").alias("hub_m"), F.lit(True).alias("hub")))
    known = rows.join(hubs, key, "left")
    rest = known.where("hub is null").drop("hub", "hub_m").join(least.where(F.col("n") <= limit).drop("n"), key)
    return known.where("hub").withColumnRenamed("hub_m", "m").drop("hub").unionByName(rest)


def _round(edges: DataFrame, n_edges: int) -> DataFrame:
    """edges: (hi, lo), hi > lo, distinct."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    large = with_least(both, "u", "v", 2 * n_edges).where("v > u").select(F.col("v").alias("hi"), F.least("m", "u").alias("lo"))
    met = with_least(large, "hi", "lo", n_edges)
    moved = met.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(met.select("hi", F.col("m").alias("lo"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges of one integral type -> (node, component), component = least node.

    Only nodes that have an edge to another node appear. Null ends, self loops and
    repeated edges are ignored. Raises if max_rounds do not suffice.
    """
    a, b = edges.columns[:2]
    current = scratch.table(spark, edges.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    seen = _mark(current)
    for _ in range(max_rounds):
        following = scratch.table(spark, _round(current, seen[0]), "edges")
        scratch.drop(spark, current)
        current, before = following, seen
        scratch.release(spark)  # a round leaves many small broadcasts
        seen = _mark(current)
        if seen == before:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
