"""Source planning, policy gate, health and state transitions (PRD-01/02, SRT-01, STM-07/08, AGG-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions.dates import hours_between
from tarnwick.operators.ordered import numbered

AUTOMATED_MODES = ("OFFICIAL_API", "RSS_ATOM", "PUBLIC_HTML_APPROVED")
SUCCESS = ("SUCCESS_COMPLETE", "SUCCESS_EMPTY", "NO_CHANGE")
SKIPPED = ("DEFERRED_BUDGET", "BACKOFF_SKIPPED", "POLICY_SKIPPED", "AUTH_SKIPPED")
#: Sources of one run, by mode.
BUDGETS = {"incremental": 40, "full": 250, "digest": 0, "maintenance": 50}


def plan(sources: DataFrame, now: Column, limit: int, full: bool = False, mandatory: tuple[str, ...] = ()) -> DataFrame:
    """Due sources with their place in the run and whether it takes them.

    sources: source_id, enabled, backoff_until, health_state, next_due_at, priority_tier, last_outcome.
    The ranking is over what is due, by ranges of the order, so no task holds the catalogue.
    """
    wanted = F.col("source_id").isin(*mandatory) if mandatory else F.lit(False)
    waiting = F.coalesce(F.col("backoff_until") > now, F.lit(False))
    due = F.lit(full) | wanted | F.col("next_due_at").isNull() | (F.col("next_due_at") <= now)
    ready = sources.where(F.col("enabled") & ~waiting & ~F.col("health_state").isin("PAUSED", "AUTH_REQUIRED") & due)
    partial = F.coalesce(F.col("last_outcome") == "PARTIAL_BUDGET", F.lit(False))
    order = [wanted.desc(), partial.desc(), F.asc_nulls_first("next_due_at"), F.col("priority_tier").asc(), F.col("source_id").asc()]
    return numbered(sources.sparkSession, ready, order, name="place").withColumn("selected", F.col("place") <= limit)


def policy_reason(url_host: Column, now: Column, zero_cost: bool = True) -> Column:
    """PRD-01: the first check a source fails, or null. Every check fails closed."""
    c, no = F.col, F.lit(False)
    ok = lambda x: F.coalesce(x, no)
    evidence = ok(c("policy_reviewed_at") <= now) & ok(c("policy_review_due_at") > now) & ok(c("policy_evidence_url") != "") & ok(c("policy_evidence_hash") != "") & ok(c("human_reviewer") != "")
    return (
        F.when(~ok(c("enabled")) | ~ok(c("policy_state") == "APPROVED"), "SOURCE_NOT_APPROVED")
        .when(~ok(c("access_mode").isin(*AUTOMATED_MODES)), "ACCESS_MODE_NOT_AUTOMATED")
        .when(~ok(c("coverage_state").isin("VERIFIED_ACTIVE", "VERIFIED_EMPTY")), "SOURCE_NOT_VERIFIED")
        .when(ok(c("health_state").isin("PAUSED", "AUTH_REQUIRED", "DOWN")), "SOURCE_HEALTH_BLOCKED")
        .when(ok(c("backoff_until") > now), "BACKOFF_ACTIVE")
        .when(F.lit(zero_cost) & ~ok(c("cost_class") == "free"), "ZERO_COST_REJECTED")
        .when(~evidence, "POLICY_EVIDENCE_MISSING_OR_OVERDUE")
        .when(ok(c("access_mode").isin("PUBLIC_HTML_APPROVED", "RSS_ATOM")) & ~ok(c("robots_allowed")), "ROBOTS_NOT_APPROVED")
        .when(~ok(F.array_contains("allowed_hosts", url_host)), "UNAPPROVED_HOST")
    )


def health(enabled: Column, state: Column, last_success: Column, failures: Column, cadence_hours: Column, backoff_until: Column, now: Column, anomaly: Column) -> Column:
    """STM-07."""
    age = F.coalesce(hours_between(last_success, now), F.lit(0.0))
    return (
        F.when(~enabled | (state == "PAUSED"), "PAUSED")
        .when(state == "AUTH_REQUIRED", "AUTH_REQUIRED")
        .when((failures >= 3) | (age > 4 * cadence_hours), "DOWN")
        .when(age > 2 * cadence_hours, "STALE")
        .when(F.coalesce(backoff_until > now, F.lit(False)), "BACKOFF")
        .when(anomaly | (failures > 0), "DEGRADED")
        .when(last_success.isNotNull(), "HEALTHY")
        .otherwise("UNKNOWN")
    )


def finish(sources: DataFrame, now: Column) -> DataFrame:
    """STM-08: one transition of each source by its row's outcome, complete, new_backoff and anomaly.

    Adds or replaces last_attempt_at, last_success_at, consecutive_failures, backoff_until,
    health_state, baseline_state, next_due_at, policy_state and last_outcome.
    """
    c = F.col
    outcome = c("outcome")
    stop, wait, auth, pause = outcome.isin("POLICY_BLOCKED", "LOGIN_REQUIRED"), outcome == "BACKOFF", outcome == "AUTH_REQUIRED", outcome == "PAUSE"
    repair, skip = outcome.isin("UNPAUSE", "REPAIR"), outcome.isin(*SKIPPED)
    special = stop | wait | auth | pause | repair | skip
    odd = ~special & c("anomaly")
    partial = ~special & ~odd & ((outcome == "PARTIAL_BUDGET") | (~c("complete") & outcome.isin(*SUCCESS)))
    good = ~special & ~odd & ~partial & c("complete") & outcome.isin(*SUCCESS)
    bad = ~special & ~odd & ~partial & ~good
    minute = F.timestamp_add("SECOND", F.lit(60), now)
    step = sources.withColumns({
        "__failures": F.when(repair | good, 0).when(bad, c("consecutive_failures") + 1).otherwise(c("consecutive_failures")),
        "__backoff": F.when(repair | good, F.lit(None)).when(wait, F.when(c("new_backoff") > now, c("new_backoff")).otherwise(minute)).when(bad, F.coalesce("new_backoff", "backoff_until")).otherwise(c("backoff_until")),
        "__success": F.when(repair, F.lit(None)).when(good, now).otherwise(c("last_success_at")),
    })
    shown = health(c("enabled"), c("health_state"), c("__success"), c("__failures"), c("cadence_hours"), c("__backoff"), now, odd)
    return step.withColumns({
        "last_attempt_at": F.when(pause | repair | skip, c("last_attempt_at")).otherwise(now),
        "health_state": F.when(auth, "AUTH_REQUIRED").when(pause, "PAUSED").when(repair, "UNKNOWN").when(good, "HEALTHY").when(stop | partial, c("health_state")).otherwise(shown),
        "baseline_state": F.when(good, "COMPLETED").when(partial & (c("baseline_state") != "COMPLETED"), "IN_PROGRESS").otherwise(c("baseline_state")),
        "next_due_at": F.when(good, F.timestamp_add("HOUR", c("cadence_hours").cast("int"), now)).otherwise(c("next_due_at")),
        "policy_state": F.when(stop, outcome).otherwise(c("policy_state")),
        "last_outcome": F.when(partial, "PARTIAL_BUDGET").otherwise(outcome),
        "consecutive_failures": c("__failures"), "backoff_until": c("__backoff"), "last_success_at": c("__success"),
    }).drop("__failures", "__backoff", "__success")


def worst_month(spark: SparkSession, first: int = 2000, last: int = 2399) -> DataFrame:
    """AGG-23: the month with most scheduled minutes over a full calendar cycle."""
    days = spark.range(1, numPartitions=1).select(F.explode(F.sequence(F.make_date(F.lit(first), F.lit(1), F.lit(1)), F.make_date(F.lit(last), F.lit(12), F.lit(31)))).alias("d"))
    week, sunday = F.count_if(F.weekday("d") < 5), F.count_if(F.weekday("d") == 6)
    minutes = (week * 6 + (F.count("*") - week) * 3) * 4 + F.count("*") * 16 + sunday * 8
    months = days.groupBy(F.year("d").alias("y"), F.month("d").alias("m")).agg(minutes.alias("scheduled_minutes"))
    return months.agg(F.max("scheduled_minutes").alias("scheduled_minutes")).withColumn("planned_minutes", F.col("scheduled_minutes") + 200)
