"""Snapshot lifecycle: yield anomalies, miss counters, states, change events (STM-*, AGG-04/12, WIN-04/06/07, DDP-08/09)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.dates import hours_between

MATERIAL = ("title", "location", "experience_text", "description_hash", "deadline", "apply_url")


def trailing_median(history: DataFrame, key: str, at: str, value: str, days: int = 14) -> DataFrame:
    """WIN-04: median and number of the values of the `days` before each row, itself excluded; both ends count.

    at is epoch seconds (long).
    """
    frame = Window.partitionBy(key).orderBy(at).rangeBetween(-days * 86_400, -1)
    return history.withColumns({"baseline": F.percentile(value, F.lit(0.5)).over(frame), "samples": F.count(value).over(frame)})


def yield_anomalies(counts: DataFrame, key: str, at: str, value: str, drop_threshold: float = 0.7, least_samples: int = 3, least_baseline: float = 10.0) -> DataFrame:
    """AGG-04, STM-10: rows that fall short of the trailing median by more than the threshold."""
    base = trailing_median(counts, key, at, value).where((F.col("samples") >= least_samples) & (F.col("baseline") >= least_baseline))
    return base.withColumn("drop_fraction", 1 - F.col(value) / F.col("baseline")).where(F.col("drop_fraction") > drop_threshold)


def miss_counters(appearances: DataFrame, counters: DataFrame, now: Column) -> DataFrame:
    """STM-01: the counters after one batch.

    appearances: appearance_uid, job_uid, seen, eligible (a complete success of an
    official inventory). counters: appearance_uid, misses, last_missing_at.
    """
    joined = appearances.join(counters, "appearance_uid", "left")
    spaced = F.col("last_missing_at").isNull() | (hours_between(F.col("last_missing_at"), now) >= 12)
    miss = ~F.col("seen") & F.col("eligible") & spaced
    misses = F.coalesce("misses", F.lit(0))
    return joined.select("appearance_uid", "job_uid", F.when(F.col("seen"), 0).when(miss, misses + 1).otherwise(misses).alias("misses"), F.when(~F.col("seen"), F.when(miss, now).otherwise(F.col("last_missing_at"))).alias("last_missing_at"))


def closure(counters: DataFrame) -> DataFrame:
    """STM-02, AGG-12: a record is as missing as its least missed appearance."""
    least = counters.groupBy("job_uid").agg(F.min("misses").alias("misses"), F.max("last_missing_at").alias("last_missing_at"))
    return least.withColumn("state", state_of(F.col("misses")))


def state_of(misses: Column) -> Column:
    return F.when(misses >= 3, "CLOSED").when(misses >= 2, "POSSIBLY_CLOSED").otherwise("ACTIVE")


def mark_missing(misses: Column, last_missing: Column, state: Column, now: Column, complete: Column, seen: Column, closed: Column) -> Column:
    """STM-03: struct(misses, last_missing_at, active_state) of one record taken alone."""
    due = complete & (last_missing.isNull() | (hours_between(last_missing, now) >= 12))
    more = misses + 1
    after = F.when(seen, F.when(state.isin("CLOSED", "POSSIBLY_CLOSED"), "REOPENED").otherwise("ACTIVE")).when(closed, "CLOSED").when(due & (more >= 2), state_of(more)).otherwise(state)
    counts = ~seen & ~closed & due
    return F.struct(F.when(seen, 0).when(counts, more).otherwise(misses).alias("misses"), F.when(~seen, F.when(counts, now).otherwise(last_missing)).alias("last_missing_at"), after.alias("active_state"))


def runs_of_misses(presence: DataFrame, key: str, order: str, seen: str) -> DataFrame:
    """WIN-07 over a whole history: misses since the last sight at each step."""
    w = Window.partitionBy(key).orderBy(order)
    blocks = presence.withColumn("__block", F.sum(F.col(seen).cast("int")).over(w))
    return blocks.withColumn("misses", F.sum((~F.col(seen)).cast("int")).over(Window.partitionBy(key, "__block").orderBy(order))).withColumn("state", state_of(F.col("misses"))).drop("__block")


def listing_presence(jobs: DataFrame, appearances: DataFrame, listed: DataFrame, now: Column) -> DataFrame:
    """STM-04, JON-12: records whose appearance is in a complete listing are seen now; their ages advance."""
    present = appearances.join(listed, ["source_id", "external_job_id"], "left_semi").select("job_uid", F.lit(True).alias("__present")).distinct()
    joined = jobs.join(present, "job_uid", "left")
    here = F.coalesce("__present", F.lit(False))
    gone_by = F.greatest(F.lit(0.0), hours_between(F.col("last_seen_at"), now))
    back = here & F.col("active_state").isin("CLOSED", "POSSIBLY_CLOSED")
    return joined.withColumns({
        "age_hours_min": F.when(here, F.col("age_hours_min") + gone_by).otherwise(F.col("age_hours_min")), "age_hours_max": F.when(here, F.col("age_hours_max") + gone_by).otherwise(F.col("age_hours_max")),
        "last_seen_at": F.when(here, F.greatest("last_seen_at", now)).otherwise(F.col("last_seen_at")), "active_state": F.when(back, "REOPENED").otherwise(F.col("active_state")), "reopened": back,
    }).drop("__present")


def material_changes(old: DataFrame, new: DataFrame, key: str, fields: tuple[str, ...] = MATERIAL) -> DataFrame:
    """DDP-08: key -> map of the fields that differ to (before, after), null-safe; unchanged keys are absent."""
    before = old.select(key, *[F.col(f).alias(f"old_{f}") for f in fields])
    joined = new.select(key, *fields).join(before, key)
    entries = [F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.struct(F.lit(f).alias("key"), F.struct(F.col(f"old_{f}").cast("string").alias("before"), F.col(f).cast("string").alias("after")).alias("value"))) for f in fields]
    return joined.select(key, F.map_from_entries(F.array_compact(F.array(*entries))).alias("diff")).where(F.size("diff") > 0)


def change_event(rules: list[tuple[Column, Column | str]]) -> Column:
    """DDP-09: the first rule that holds names the event; empty if none."""
    first, *rest = rules
    return reduce(lambda c, r: c.when(*r), rest, F.when(*first)).otherwise("")


def record_change_event(old: str = "old_", new: str = "") -> Column:
    """DDP-09 for records: lifecycle, then URL, deadline, location, eligibility."""
    o, n = lambda f: F.col(old + f), lambda f: F.col(new + f)
    moved = lambda f: ~o(f).eqNullSafe(n(f))
    return change_event([
        (n("active_state").isin("REOPENED", "CLOSED") & moved("active_state"), n("active_state")),
        (moved("apply_url"), "APPLY_URL_REPLACED"),
        (n("deadline").isNotNull() & (o("deadline").isNull() | (n("deadline") < o("deadline"))), "EARLIER_DEADLINE"),
        (moved("location"), "LOCATION_CHANGED"),
        (moved("min_years") | moved("max_years") | moved("education_constraint"), "ELIGIBILITY_CHANGED"),
    ])
