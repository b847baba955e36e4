"""Periodic summaries, failure episodes, schedules, checkpoints and exchange (PRD-03/06/09, STM-05/11/13/14/15, SNK-06/08, DDP-11)."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.functions.dates import due_now
from tarnwick.functions.hashing import digest, uid

# Local and UTC cron texts of each mode of run.
SCHEDULES = {
    "incremental": ("47 6,9,12,15,18,21 * * 1-5", "17 1,4,7,10,13,16 * * 1-5", "47 9,15,21 * * 0,6", "17 4,10,16 * * 0,6"),
    "full": ("23 2 * * *", "53 20 * * *"),
    "morning": ("11 8 * * *", "41 2 * * *"),
    "evening": ("11 19 * * *", "41 13 * * *"),
    "maintenance": ("43 3 * * 0", "13 22 * * 6"),
}


def mode_of(cron: Column) -> Column:
    """STM-15: the mode of a schedule; an unknown one raises."""
    found = F.when(F.lit(False), "")
    for mode, texts in SCHEDULES.items():
        found = found.when(cron.isin(*texts), mode)
    return F.coalesce(found, F.raise_error(F.lit("UNKNOWN_SCHEDULE")).cast("string"))


def digest_items(jobs: DataFrame, applications: DataFrame, outreach: DataFrame, alerts: DataFrame, cursor: Column, now: Column) -> DataFrame:
    """PRD-06: (kind, job_uid, line) of what a summary since cursor tells.

    NEW are P0 and P1 records first seen since or with a delivery in doubt; OVERDUE and
    FOLLOW_UP have a due text; CHANGED changed since. A null cursor is the beginning.
    """
    since = lambda c: cursor.isNull() | (F.col(c) > cursor)
    doubt = alerts.where(F.col("state").isin("AMBIGUOUS", "SENDING")).select("job_uid", F.lit(True).alias("doubt")).distinct()
    listed = jobs.where(F.col("action_priority").isin("P0", "P1")).join(doubt, "job_uid", "left").where(since("first_seen_at") | F.col("doubt"))
    line = lambda df, kind, text: df.select(F.lit(kind).alias("kind"), "job_uid", F.concat_ws(": ", "job_uid", text).alias("line"))
    overdue = applications.where(due_now(F.col("next_step_due"), now))
    follow = outreach.where(~F.col("outreach_stage").isin("CLOSED", "DO_NOT_CONTACT") & due_now(F.col("follow_up_due"), now))
    changed = jobs.where(F.col("last_changed_at").isNotNull() & since("last_changed_at"))
    return (
        line(listed, "NEW", F.col("action_priority"))
        .unionByName(line(overdue, "OVERDUE", F.coalesce(F.nullif("next_step", F.lit("")), "application_stage", F.lit(""))))
        .unionByName(line(follow, "FOLLOW_UP", F.lit("review due follow-up")))
        .unionByName(line(changed, "CHANGED", F.col("active_state")))
    )


def digest_attempt(period: str, window_end: Column, cursor: Column, members: DataFrame, alerts: DataFrame) -> DataFrame:
    """STM-13: one row to record, or none if this window has one already.

    No members give NO_CONTENT, which still moves the cursor.
    """
    prior = alerts.where(F.col("alert_type").isin("DIGEST", "NO_CONTENT")).select(F.col("scheduled_window_end"))
    count = members.agg(F.count("*").alias("items"), F.bit_xor(F.xxhash64("alert_id")).alias("content"))
    kind = F.when(F.col("items") > 0, "DIGEST").otherwise("NO_CONTENT")
    row = count.select(digest(period=F.lit(period), cursor=F.coalesce(cursor.cast("string"), F.lit("INITIAL")), end=window_end, content=F.col("content")).alias("digest_id"), kind.alias("alert_type"), F.when(kind == "DIGEST", "PENDING").otherwise("SENT").alias("state"), window_end.alias("scheduled_window_end"), "items")
    return row.join(prior, "scheduled_window_end", "left_anti")


def failure_notices(conditions: DataFrame, state: DataFrame, least_failures: int = 3) -> DataFrame:
    """STM-14: one FAILURE and one RECOVERY per episode of a condition.

    conditions: condition, active, due_failures (null: not counted). state: condition,
    was_active, episode.
    """
    known = conditions.join(state, "condition", "left").withColumns({"was_active": F.coalesce("was_active", F.lit(False)), "episode": F.coalesce("episode", F.lit(0))})
    ready = known.where(~(F.col("active") & F.coalesce(F.col("due_failures") < least_failures, F.lit(False))) & (F.col("active") != F.col("was_active")))
    kind = F.when(F.col("active"), "FAILURE").otherwise("RECOVERY")
    numbered = ready.withColumn("episode", F.col("episode") + F.col("active").cast("int")).withColumn("kind", kind)
    return numbered.select("condition", "kind", "episode", "active", digest(condition=F.col("condition"), episode=F.col("episode"), kind=kind).alias("alert_id"))


def failure_episodes(history: DataFrame, key: str, at: str, failed: str, least: int = 3) -> DataFrame:
    """STM-14 over a history: each row's run of failures, and where a notice is due."""
    w = Window.partitionBy(key).orderBy(at)
    blocks = history.withColumn("__block", F.sum((~F.col(failed)).cast("int")).over(w))
    run = F.sum(F.col(failed).cast("int")).over(Window.partitionBy(key, "__block").orderBy(at))
    counted = blocks.withColumn("failures", run)
    before = F.coalesce(F.lag("failures").over(w), F.lit(0))
    return counted.withColumn("notice", F.when(F.col("failures") == least, "FAILURE").when(~F.col(failed) & (before >= least), "RECOVERY")).drop("__block")


def title_in_scope(title: Column, terms: tuple[str, ...]) -> Column:
    """PRD-03: one of the terms is part of the title, whatever the case."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t))


def valid_checkpoints(checkpoints: DataFrame, appearances: DataFrame, jobs: DataFrame) -> DataFrame:
    """STM-05, JON-02: checkpoints whose version is a digest and whose appearance and record are committed.

    checkpoints: key, source_id, external_job_id, job_uid, version.
    """
    committed = appearances.join(jobs.select("job_uid"), "job_uid", "left_semi").select("source_id", "external_job_id", "job_uid")
    named = checkpoints.where(F.col("version").rlike("^[0-9a-f]{64}$") & (F.col("key") == F.concat(F.lit("checkpoint:"), uid(F.col("source_id"), F.col("external_job_id")))))
    return named.join(committed, ["source_id", "external_job_id", "job_uid"], "left_semi")


def snapshot_kind(baseline_done: Column, full: Column) -> Column:
    """STM-11."""
    return F.when(~F.coalesce(baseline_done, F.lit(False)), "BASELINE").when(full, "FULL").otherwise("INCREMENTAL")


def events_of(changes: DataFrame, run_uid: str, known: DataFrame) -> DataFrame:
    """DDP-11: change events with ids by content; those already stored are left out.

    changes: job_uid, event, sequence.
    """
    named = changes.withColumn("event_uid", uid(F.col("job_uid"), F.col("event"), F.col("sequence"))).withColumn("run_uid", F.lit(run_uid))
    return named.join(known.select("event_uid"), "event_uid", "left_anti")


def export_backup(tables: dict[str, DataFrame], folder: str) -> None:
    """SNK-06: one folder of JSON lines per table."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{folder}/{name}")


def stage_import(spark: SparkSession, rows: DataFrame, folder: str, content: bytes, key: bytes) -> str:
    """SNK-08: staged below a keyed digest of the content, which tells nothing without the key; staging it again changes nothing."""
    path = f"{folder}/{hmac.new(key, content, hashlib.sha256).hexdigest()}"
    rows.write.mode("ignore").parquet(path)
    return path
