"""Values that depend on the order of a key's rows, without gathering a key in one task.

A key's rows are cut into blocks of the order column. Blocks are aggregated map-side,
the few block results of a key are put in order, and rows then look back inside their
own block only. A key that holds a third of all rows is as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick import scratch

_AGGREGATE = {"min": F.min, "max": F.max, "sum": F.sum}


def _both(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a + b, a, b)
    return F.least(a, b) if kind == "min" else F.greatest(a, b)


def before(df: DataFrame, keys: list[str], at: str, what: dict[str, tuple[str, Column]], block_rows: int = 100_000) -> DataFrame:
    """df plus, by name, (min, max or sum) of a value over the rows of the same keys whose ``at`` is less.

    ``at`` is a whole number, keys are not null. Rows of one ``at`` do not see each
    other. A value that no earlier row has is null; nulls are passed over.
    """
    held = df.withColumn("__block", F.floor(F.col(at) / F.lit(block_rows)).cast("long")).withColumns({f"__v_{n}": c for n, (_, c) in what.items()})
    totals = held.groupBy(*keys, "__block").agg(*[_AGGREGATE[kind](f"__v_{n}").alias(f"__t_{n}") for n, (kind, _) in what.items()])
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), *[_AGGREGATE[kind](f"__t_{n}").over(earlier).alias(f"__c_{n}") for n, (kind, _) in what.items()])
    inside = Window.partitionBy(*keys, "__block").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    looked = held.withColumns({f"__i_{n}": _AGGREGATE[kind](f"__v_{n}").over(inside) for n, (kind, _) in what.items()})
    same = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        same &= F.col(k) == F.col(f"__k{i}")
    return looked.join(carried, same).select(*[F.col(f"`{c}`") for c in df.columns], *[_both(kind, F.col(f"__c_{n}"), F.col(f"__i_{n}")).alias(n) for n, (kind, _) in what.items()])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], inclusive: bool = True, block_rows: int = 100_000) -> DataFrame:
    """left plus the values of the last row of right with the same keys and an ``at`` not later (or earlier, if not inclusive).

    ``at`` is a whole number on both sides (microseconds, a sequence number). No range
    join: the two sides are stacked and every row takes the last known values. Rows of
    right that share keys and ``at`` are told apart by their values, the greatest counts;
    a null value of the last row stays null. Left rows with a null key or ``at`` find none.
    """
    know = F.struct(F.col(at).alias("at"), *[F.col(v) for v in values])
    ask = F.col(at) if inclusive else F.col(at) - 1
    lined = [F.col(k) for k in keys]
    left_rows = left.select(*lined, (ask + 1).alias("__at"), F.lit(None).cast(right.select(know.alias("k")).schema["k"].dataType).alias("__known"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__left"))
    right_rows = right.select(*lined, F.col(at).alias("__at"), know.alias("__known"), F.lit(None).cast(left_rows.schema["__left"].dataType).alias("__left"))
    usable = F.col("__at").isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    found = before(left_rows.where(usable).unionByName(right_rows.where(usable)), keys, "__at", {"__last": ("max", F.col("__known"))}, block_rows).where("__left is not null")
    named = found.select("__left.*", *[F.col(f"__last.{v}").alias(v) for v in values])
    return named.unionByName(left_rows.where(~usable).select("__left.*", *[F.lit(None).cast(named.schema[v].dataType).alias(v) for v in values]))


def numbered(spark: SparkSession, df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df plus its rank (from 1) in the order, within group or over all, without one task for a group.

    Rows are range-partitioned by group and order and sorted; each partition's rows are
    counted by group, and a row's rank is its place in the partition plus the rows of
    its group before the partition. ``order`` should be unique; ties are ranked in any order.
    """
    group = group or []
    dealt = df.repartitionByRange(*[F.col(g).asc_nulls_first() for g in group], *order).sortWithinPartitions(*[F.col(g).asc_nulls_first() for g in group], *order)
    # Written once, so that a row's partition and place cannot change between the two uses.
    held = scratch.table(spark, dealt.withColumn("__id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__id", 33)
    marks = held.groupBy(*[F.col(g).alias(f"__g{n}") for n, g in enumerate(group)], part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    earlier = Window.partitionBy(*[f"__g{n}" for n in range(len(group))]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marks.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    same = F.shiftright(held["__id"], 33) == offsets["__part"]
    for n, g in enumerate(group):
        same &= held[g].eqNullSafe(offsets[f"__g{n}"])
    return held.join(F.broadcast(offsets) if not group else offsets, same).select(*[held[c] for c in df.columns], (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias(name))


def ordered_union(rows: DataFrame, key: str, order: str, entries: str, by: list[str] | None = None) -> DataFrame:
    """(key, entries): the entries of a key's rows in their order, the first of each kind only.

    entries is a column of arrays of structs; ``by`` names the fields that make two
    entries one (all of them if none is named). Nulls, empty arrays and null entries add
    nothing. Repeats go map-side, so only the distinct entries of a key are gathered.
    """
    each = rows.select(key, order, F.posexplode(entries).alias("__pos", "__entry")).where("__entry is not null")
    kind = F.struct(*[F.col("__entry")[b].alias(b) for b in by]) if by else F.col("__entry")
    first = each.groupBy(key, kind.alias("__kind")).agg(F.min_by("__entry", F.struct(order, "__pos")).alias("__entry"), F.min(F.struct(F.col(order).alias("at"), F.col("__pos").alias("pos"))).alias("__at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__entry")), lambda a, b: F.when(a["__at"] < b["__at"], -1).otherwise(1)), lambda x: x["__entry"]).alias(entries))
