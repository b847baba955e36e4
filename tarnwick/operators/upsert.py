"""Keyed upsert without MERGE (SNK-*, DDP-10, JON-09)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """A table's key, the columns that only users may write, and whether rows are final."""

    name: str
    key: str
    columns: tuple[str, ...]
    user_columns: tuple[str, ...] = ()
    append_only: bool = False


def upsert(old: DataFrame, new: DataFrame, spec: TableSpec, order: str | None = None) -> DataFrame:
    """The table after the write, with ``change``: INSERTED, CHANGED, SAME or KEPT.

    One full outer join on the key. Of several new rows of a key the one with the largest
    order counts, then the largest by all columns; they are reduced map-side first. Machine writes keep user columns of known rows
    (SNK-03). In an append-only table a known key with other content raises (SNK-02).
    Columns outside the spec are dropped; a missing one keeps the old value.
    """
    given = [c for c in spec.columns if c in new.columns]
    left = old.select(F.col(spec.key), F.struct(*spec.columns).alias("was"))
    row = F.struct(*given)
    right = new.groupBy(spec.key).agg((F.max_by(row, F.struct(order, row)) if order else F.max(row)).alias("now"))
    both = left.join(right, spec.key, "full_outer")
    owned = set(spec.user_columns)
    known, sent = F.col("was").isNotNull(), F.col("now").isNotNull()

    def value(c: str):
        if c == spec.key:
            return F.col(spec.key)
        if c not in given:
            return F.col(f"was.{c}").alias(c)
        fresh = F.when(sent & ~known, F.col(f"now.{c}")).otherwise(F.col(f"was.{c}")) if c in owned else F.when(sent, F.col(f"now.{c}")).otherwise(F.col(f"was.{c}"))
        return fresh.alias(c)

    differs = F.lit(False)
    for c in given:
        if c != spec.key and c not in owned:
            differs = differs | ~F.col(f"now.{c}").eqNullSafe(F.col(f"was.{c}"))
    change = F.when(~known, "INSERTED").when(~sent, "KEPT").when(differs, "CHANGED").otherwise("SAME")
    if spec.append_only:
        change = F.when(known & sent & differs, F.raise_error(F.lit(f"APPEND_ONLY_CONFLICT:{spec.name}")).cast("string")).otherwise(change)
    return both.select(*[value(c) for c in spec.columns], change.alias("change"))


def append_new(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """JON-09: the rows of new whose key is not there yet."""
    return new.join(old.select(*keys), list(keys), "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """SNK-05: keys that are not unique, null, or blank."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    return df.groupBy(key).agg(F.count("*").alias("copies")).where((F.col("copies") > 1) | blank)


def finalized(tables: dict[str, tuple[DataFrame, str]], run_uid: str) -> DataFrame:
    """SNK-05: (run_uid, state, faults): COMMITTED if the keys of all tables are unique and filled, else REJECTED with how many are not."""
    found = [duplicate_keys(df, key).agg(F.lit(name).alias("name"), F.count("*").alias("faults")) for name, (df, key) in sorted(tables.items())]
    counts = found[0]
    for one in found[1:]:
        counts = counts.unionByName(one)
    state = F.when(F.sum("faults") == 0, "COMMITTED").otherwise("REJECTED")
    return counts.agg(F.lit(run_uid).alias("run_uid"), state.alias("state"), F.sum("faults").alias("faults"))


def verify_schema(df: DataFrame, spec: TableSpec, version: str, expected: str) -> None:
    """OPS-02: fail before any read or write if columns or version drifted."""
    if tuple(df.columns) != spec.columns or version != expected:
        raise ValueError(f"SCHEMA_DRIFT:{spec.name}")
