"""Dashboard numbers: facts per record, funnel, cohorts, distributions, action queue (RPT-*, AGG-*, JON-06/08)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.dates import hours_between, instant

# Stages that count as an interview, an offer, and as settled; states of a reply.
INTERVIEW_STAGES = ("RECRUITER_SCREEN", "TECH_SCREEN", "HM_ROUND", "INTERVIEW_LOOP")
OFFER_STAGES = ("OFFER", "ACCEPTED", "DECLINED")
SETTLED_STAGES = ("ACCEPTED", "DECLINED", "REJECTED", "WITHDRAWN", "ROLE_CLOSED", "SKIPPED")
REPLY_STATES = ("REPLIED", "RECEIVED", "POSITIVE", "NEGATIVE")


def _kept(df: DataFrame, key: str, pick: Callable[..., Column], order: str) -> DataFrame:
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key])
    return df.groupBy(key).agg(pick(rest, order).alias("__row")).select(key, "__row.*")


def first_row(df: DataFrame, key: str, order: str) -> DataFrame:
    """AGG-13: the row of each key with the least order, by an ordered minimum that combines map-side; rows without one are none."""
    return _kept(df, key, F.min_by, order).where(F.col(order).isNotNull())


def last_row(df: DataFrame, key: str, order: str) -> DataFrame:
    """AGG-14: the row of each key with the greatest order."""
    return _kept(df, key, F.max_by, order).where(F.col(order).isNotNull())


def or_unknown(x: Column, default: str = "UNKNOWN") -> Column:
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit(default))


def record_facts(jobs: DataFrame, applications: DataFrame, appearances: DataFrame, companies: DataFrame, events: DataFrame, outreach: DataFrame, now: Column) -> DataFrame:
    """JON-06: one row per record with its labels and counts.

    Every right side is first reduced to one row per key. Columns: appearances and
    applications carry ``pos``, their order; times are ISO strings with offset.
    Raises on the first duplicate job_uid it meets.
    """
    named = jobs.where(F.coalesce("job_uid", F.lit("")) != "")
    checked = named.withColumn("__copies", F.count("*").over(Window.partitionBy("job_uid")))
    checked = checked.withColumn("job_uid", F.when(F.col("__copies") > 1, F.raise_error(F.lit("DUPLICATE_CANONICAL_JOB_UID")).cast("string")).otherwise(F.col("job_uid")))
    app = last_row(applications, "job_uid", "pos").select("job_uid", instant(F.col("applied_at")).alias("applied_at"), "application_stage")
    source = first_row(appearances, "job_uid", "pos").select("job_uid", or_unknown(F.col("source_id"), "UNATTRIBUTED").alias("source"))
    tier = last_row(companies.withColumn("__company", F.lower("company")), "__company", "pos").select("__company", "company_tier")
    stages = events.groupBy("job_uid").agg(F.collect_set("to_stage").alias("past"))
    sent_by_now = outreach.where(instant(F.col("sent_at")) <= now)
    replied = (F.col("outreach_stage") == "REPLIED") | F.upper("reply_state").isin(*REPLY_STATES)
    sent = sent_by_now.groupBy("job_uid").agg(F.count("*").alias("sent"), F.count_if(F.coalesce(replied, F.lit(False))).alias("replied"))
    joined = checked.withColumn("__company", F.lower("company")).join(app, "job_uid", "left").join(source, "job_uid", "left").join(tier, "__company", "left").join(stages, "job_uid", "left").join(sent, "job_uid", "left")
    seen = F.array_union(F.coalesce("past", F.array().cast("array<string>")), F.array(F.coalesce("application_stage", F.lit(""))))
    applied = F.coalesce(F.col("applied_at") <= now, F.lit(False))
    first_seen = instant(F.col("first_seen_at"))
    return joined.select(
        "job_uid",
        F.coalesce("source", F.lit("UNATTRIBUTED")).alias("source"),
        or_unknown(F.col("role_family")).alias("role"),
        F.when(F.coalesce(F.col("company_tier").cast("string"), F.lit("")) != "", F.concat(F.lit("Tier "), F.col("company_tier").cast("string"))).otherwise("UNASSIGNED").alias("tier"),
        or_unknown(F.col("freshness_band")).alias("freshness_band"),
        applied.alias("applied"),
        (applied & F.arrays_overlap(seen, F.array(*map(F.lit, INTERVIEW_STAGES)))).alias("interviewed"),
        (applied & F.arrays_overlap(seen, F.array(*map(F.lit, OFFER_STAGES)))).alias("offered"),
        (applied & F.array_contains(seen, "ACCEPTED")).alias("accepted"),
        F.when(applied & (F.col("applied_at") >= first_seen), hours_between(first_seen, F.col("applied_at"))).alias("apply_hours"),
        F.coalesce("sent", F.lit(0).cast("long")).alias("sent"),
        F.coalesce("replied", F.lit(0).cast("long")).alias("replied"),
    )


def funnel(facts: DataFrame) -> DataFrame:
    """AGG-06."""
    return facts.agg(*[F.count_if(c).alias(n) for c, n in (("applied", "applications"), ("interviewed", "interviews"), ("offered", "offers"), ("accepted", "accepted"))])


def apply_hours(facts: DataFrame, *keys: str) -> DataFrame:
    """AGG-07: median and sample size over valid intervals."""
    return facts.groupBy(*keys).agg(F.median("apply_hours").alias("median_apply_hours"), F.count("apply_hours").alias("median_samples"))


def cohorts(facts: DataFrame) -> DataFrame:
    """AGG-08: applications, interviews, sent and replied by source, role and tier, with rates."""
    wide = facts.groupingSets([["source"], ["role"], ["tier"]], "source", "role", "tier").agg(
        F.grouping_id().alias("__set"), F.count_if("applied").alias("applications"), F.count_if("interviewed").alias("interviews"), F.sum("sent").alias("sent"), F.sum("replied").alias("replied")
    )
    which = F.when(F.col("__set") == 3, "source").when(F.col("__set") == 5, "role").otherwise("tier")
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return wide.select(which.alias("dimension"), F.coalesce("source", "role", "tier").alias("label"), "applications", "interviews", "sent", "replied", rate("interviews", "applications").alias("interview_rate"), rate("replied", "sent").alias("reply_rate"))


def distribution(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """AGG-11, SRT-06: counts with blanks as UNKNOWN; the top ones by count, then label."""
    counts = df.groupBy(or_unknown(F.col(column)).alias("label")).agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), "label").limit(top)


def enum_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """AGG-16: one row per listed value, zero where there is none."""
    listed = df.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, values))).alias("label"))
    return listed.join(df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


AMOUNTS = ("salary_base_min", "salary_base_max", "salary_total_min", "salary_total_max")
SOURCED = ("OBSERVED", "SOURCE_BACKED", "EXACT")


def pay_figures(jobs: DataFrame, target_lakh: float | None) -> DataFrame:
    """AGG-19: share of named records with a known, sourced amount, and how many reach the target; one row.

    Without records the rate is null, without a positive target the number is.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    amount = reduce(or_, (F.col(c).isNotNull() for c in AMOUNTS))
    yearly = F.upper("salary_period").isin("ANNUAL", "YEAR") & (F.col("salary_currency") == "INR") & F.col("salary_confidence").isin(*SOURCED)
    open_ = ~F.col("active_state").eqNullSafe("CLOSED") & ~F.col("action_priority").eqNullSafe("EXCLUDED")
    reached = (F.col("salary_base_min") >= target_lakh * 100_000) & yearly & filled("salary_source") & open_ if target_lakh and target_lakh > 0 else None
    count = F.lit(None).cast("long") if reached is None else F.count_if(F.coalesce(reached, F.lit(False)))
    return jobs.where(filled("job_uid")).agg(F.avg((amount & filled("salary_source")).cast("int")).alias("known_pay_rate"), count.alias("reach_target"))


def source_figures(sources: DataFrame, now: Column) -> DataFrame:
    """AGG-19: largest cadence and oldest last success, in hours, of enabled sources; one row, null without any."""
    past = F.when(F.col("last_success_at") <= now, hours_between(F.col("last_success_at"), now))
    return sources.where("enabled").agg(F.max("cadence_hours").alias("largest_cadence"), F.max(past).alias("largest_age"))


def action_queue(jobs: DataFrame, applications: DataFrame, outreach: DataFrame, now_local: str) -> DataFrame:
    """RPT-02: open records by priority, overdue first, due, uid.

    now_local is "YYYY-MM-DD HH:MM"; overdue compares texts, as the due column is text.
    Of several outreach rows of a record the last counts.
    """
    app = last_row(applications, "job_uid", "pos").select("job_uid", "application_stage", "next_step", "next_step_due", "referral_stage")
    draft = last_row(outreach, "job_uid", "pos").select("job_uid", "outreach_stage", "follow_up_due")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    stage = F.coalesce("application_stage", F.lit("NOT_STARTED"))
    joined = jobs.join(app, "job_uid", "left").join(draft, "job_uid", "left")
    open_ = joined.where(~stage.isin(*SETTLED_STAGES) & ~F.coalesce("action_priority", F.lit("P2")).isin("EXCLUDED", "P3"))
    due = F.coalesce(filled("next_step_due"), filled("follow_up_due"), F.col("action_by_ist"), F.lit(""))
    return open_.select(
        "job_uid", F.coalesce("action_priority", F.lit("P2")).alias("action_priority"), F.when((due != "") & (F.substring(due, 1, 16) < now_local), "OVERDUE").otherwise("").alias("overdue"), due.alias("action_by_ist"),
        F.coalesce(filled("next_step"), F.col("next_action"), F.lit("")).alias("next_action"), stage.alias("application_stage"), F.coalesce("referral_stage", F.lit("NOT_STARTED")).alias("referral_stage"), F.coalesce("outreach_stage", F.lit("")).alias("outreach_stage"),
    ).orderBy("action_priority", F.col("overdue") != "OVERDUE", "action_by_ist", "job_uid")
