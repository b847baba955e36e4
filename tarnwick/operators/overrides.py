"""Stored models with cells on top, and manual values as of a time (SRC-16, SCR-01, SCR-11, SCR-12)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.operators.ordered import as_of
from tarnwick.operators.score import ScoringConfig

_STOPS = ("POLICY_BLOCKED", "LOGIN_REQUIRED")
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def _cell(name: str, held: T.DataType, wanted: T.DataType) -> Column:
    """A cell as a value of the wanted type; blank and unreadable ones are null."""
    cell = F.col(f"`{name}`")
    if held == wanted:
        return F.nullif(cell, F.lit("")) if isinstance(wanted, T.StringType) else cell
    text = F.nullif(F.trim(cell.cast("string")), F.lit(""))
    return F.from_json(text, wanted) if isinstance(wanted, _NESTED) else text.try_cast(wanted)


def typed(rows: DataFrame, schema: str, model: str = "model_json", cells: bool = True) -> DataFrame:
    """SRC-16: the fields of schema from the stored JSON, each under the row's own cell of that name if it is filled.

    Cells of arrays, maps and structs are JSON. Columns that are no field pass through;
    a model that is null, blank or broken leaves the cells alone.
    """
    fields = T.StructType.fromDDL(schema).fields
    held = {f.name: f.dataType for f in rows.schema.fields}
    read = rows.withColumn("__model", F.from_json(F.nullif(F.trim(model), F.lit("")), T.StructType(fields)))
    value = {f.name: F.coalesce(_cell(f.name, held[f.name], f.dataType), F.col(f"__model.{f.name}")) if cells and f.name in held else F.col(f"__model.{f.name}") for f in fields}
    rest = [c for c in rows.columns if c not in value and c != model]
    return read.select(*[F.col(f"`{c}`") for c in rest], *[c.alias(n) for n, c in value.items()])


def load_sources(rows: DataFrame, schema: str) -> DataFrame:
    """Sources with cells on top; a recorded stop in their metadata is their policy state."""
    found = typed(rows, schema)
    stop = F.try_element_at("metadata", F.lit("policy_stop"))
    return found.withColumn("policy_state", F.when(stop.isin(*_STOPS), stop).otherwise(F.col("policy_state")))


def load_jobs(rows: DataFrame, schema: str) -> DataFrame:
    """Records as stored; of the cells only the mark that a record stays apart counts."""
    marked = F.coalesce(F.lower(F.col("do_not_merge").cast("string")) == "true", F.lit(False)) if "do_not_merge" in rows.columns else F.lit(False)
    return typed(rows.withColumn("__apart", marked), schema, cells=False).withColumn("do_not_merge", F.col("__apart")).drop("__apart")


def load_contacts(rows: DataFrame, schema: str) -> DataFrame:
    """Contacts have no stored model: every filled cell counts."""
    return typed(rows.withColumn("__none", F.lit(None).cast("string")), schema, model="__none")


def manual_as_of(records: DataFrame, overrides: DataFrame, key: str, at: str, values: list[str], reason: str = "reason", block_rows: int = 100_000) -> DataFrame:
    """SCR-12: records plus the manual values of the last override not later than ``at``; without a reason it gives none.

    A later override without a reason takes an earlier one away. ``at`` is a whole number.
    """
    clash = [c for c in (*values, reason) if c in records.columns]
    found = as_of(records.drop(*clash), overrides, [key], at, [*values, reason], block_rows=block_rows)
    stated = F.trim(F.coalesce(reason, F.lit(""))) != ""
    return found.withColumns({v: F.when(stated, F.col(v)) for v in values}).withColumn(reason, F.when(stated, F.col(reason)))


def due_no_later(new: Column, previous: Column) -> Column:
    """SCR-11: the earlier of two due texts of one format; a blank one does not count against the other."""
    return F.when((F.coalesce(new, F.lit("")) == "") | (F.coalesce(previous, F.lit("")) == ""), new).otherwise(F.least(new, previous))


def scoring_config(spark: SparkSession, rows: DataFrame, at: Column | None = None, base: ScoringConfig | None = None) -> ScoringConfig:
    """SCR-01: a configuration with the last value of each known setting not later than ``at`` on top.

    rows: name (fit.role, priority.freshness, p2_priority, ...), value, set_at. At most one
    row a setting reaches the driver. Unknown names are passed over; weights that then do
    not total 100 are refused by ScoringConfig.
    """
    base = base or ScoringConfig()
    plain = ("p2_priority", "stale_penalty", "unverified_penalty", "duplicate_penalty")
    known = [f"fit.{k}" for k in base.fit] + [f"priority.{k}" for k in base.priority] + list(plain)
    usable = rows.where(F.col("name").isin(*known) & F.col("value").isNotNull())
    if at is not None:
        usable = usable.where(F.col("set_at") <= at)
    last = {r["name"]: float(r["value"]) for r in usable.groupBy("name").agg(F.max_by("value", F.struct("set_at", "value")).alias("value")).collect()}
    weights = {part: {k: last.get(f"{part}.{k}", v) for k, v in getattr(base, part).items()} for part in ("fit", "priority")}
    return replace(base, **weights, **{k: last[k] for k in plain if k in last})
