"""Alert decisions and delivery plans; nothing is sent (OBX-*, SRT-03, PRD-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.dates import IST
from tarnwick.functions.hashing import digest
from tarnwick.functions.text import redact
from tarnwick.operators.ordered import numbered

UPDATE_EVENTS = ("APPLY_URL_REPLACED", "EARLIER_DEADLINE", "ELIGIBILITY_CHANGED", "LOCATION_CHANGED", "CLOSED", "REOPENED")
PER_RUN, PER_DAY = 5, 18


def decisions(jobs: DataFrame, existing: DataFrame, changes: DataFrame) -> DataFrame:
    """OBX-01: alerts due now that are not in the outbox.

    jobs: job_uid, priority_score, action_priority, quarantine_reason, baseline,
    posted_at_source, age_hours_max, material_version. existing: alert_id, job_uid,
    alert_type. changes: job_uid, event. One P0 alert per record ever; afterwards only
    listed events.
    """
    told = existing.where(F.col("alert_type").isin("P0", "UPDATE")).select("job_uid", F.lit(True).alias("told")).distinct()
    joined = jobs.join(told, "job_uid", "left").join(changes.select("job_uid", "event"), "job_uid", "left")
    told_ = F.coalesce("told", F.lit(False))
    update = told_ & F.coalesce(F.col("event").isin(*UPDATE_EVENTS), F.lit(False))
    old_news = F.col("baseline") & (F.col("posted_at_source").isNull() | F.col("age_hours_max").isNull() | (F.col("age_hours_max") > 48))
    due = joined.where(~F.col("action_priority").isin("PIPELINE", "EXCLUDED") & (F.coalesce("quarantine_reason", F.lit("")) == "") & (update | ((F.col("action_priority") == "P0") & ~told_ & ~old_news)))
    kind = F.when(update, "UPDATE").otherwise("P0")
    named = due.withColumn("alert_type", kind).withColumn("alert_id", digest(job=F.col("job_uid"), type=kind, version=F.col("material_version")))
    return named.select("alert_id", "job_uid", "alert_type", "material_version", "priority_score").join(existing.select("alert_id"), "alert_id", "left_anti")


def material_version(priority_transition: Column | None = None, template: str = "v1") -> Column:
    """HSH-05: digest of what a reader would have to be told again; no clock, age or score is part of it.

    Reads the normalized columns, apply_url being canonical. Null differs from empty, except for the URL.
    """
    names = ("location", "work_mode", "visa_text", "min_years", "max_years", "education_constraint")
    text = lambda c: F.col(c).cast("string")
    url = F.coalesce("apply_url", F.lit(""))
    return digest(
        publication=text("posted_at_source"), publication_confidence=F.col("posted_at_confidence"), priority_transition=F.lit("") if priority_transition is None else priority_transition, apply_url=F.when(url != "", F.sha2(url, 256)).otherwise(""),
        active_state=F.col("active_state"), deadline=text("deadline"), eligibility=digest(**{n: text(n) for n in names}), description_sequence=F.col("material_change_sequence"), template=F.lit(template),
    )


def used_today(existing: DataFrame, now: Column) -> DataFrame:
    """OBX-02: distinct bundles or alerts of today's IST day that are no longer pending."""
    day = lambda x: F.to_date(F.from_utc_timestamp(x, IST))
    today = existing.where((F.col("state") != "PENDING") & F.col("alert_type").isin("P0", "UPDATE") & (day(F.coalesce("sending_at", "created_at")) == day(now)))
    return today.agg(F.countDistinct(F.coalesce(F.nullif(F.col("bundle_id"), F.lit("")), F.col("alert_id"))).alias("used"))


def bundle(pending: DataFrame, used: DataFrame | None, order: list[Column], group: list[str] | None = None, per_run: int = PER_RUN, per_day: int = PER_DAY) -> DataFrame:
    """SRT-03: up to the capacity single messages; beyond it the last one bundles the rest.

    With group, each group has a capacity of its own; used carries (group..., used).
    Places are ranks by ranges, so a group of any size is many tasks.
    """
    keys = group or []
    totals = pending.groupBy(*keys).agg(F.count("*").alias("pending")) if keys else pending.agg(F.count("*").alias("pending"))
    if used is None:
        totals = totals.withColumn("used", F.lit(0).cast("long"))
    elif keys:
        totals = totals.join(used, keys, "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    else:
        totals = totals.crossJoin(F.broadcast(used))  # one row each
    capacity = F.greatest(F.lit(0), F.least(F.lit(per_run), F.lit(per_day) - F.col("used")))
    placed = numbered(pending.sparkSession, pending, order, keys, "place")
    same = F.lit(True)
    for k in keys:
        same &= placed[k].eqNullSafe(totals[k])
    ranked = placed.join(totals, same) if keys else placed.crossJoin(F.broadcast(totals))
    ranked = ranked.select(*[placed[c] for c in placed.columns], totals["pending"], capacity.cast("int").alias("capacity"))
    single = (F.col("pending") <= F.col("capacity")) | (F.col("place") < F.col("capacity"))
    return ranked.withColumn("message", F.when(F.col("capacity") == 0, "DEFERRED").when(single, "SINGLE").otherwise("BUNDLE"))


def claim(outbox: DataFrame, now: Column) -> DataFrame:
    """OBX-04: pending rows become SENDING; rows found SENDING were interrupted and are AMBIGUOUS."""
    state = F.when(F.col("state") == "SENDING", "AMBIGUOUS").when(F.col("state") == "PENDING", "SENDING").otherwise(F.col("state"))
    return outbox.withColumns({"sending_at": F.when(F.col("state") == "PENDING", now).otherwise(F.col("sending_at")), "state": state})


def claim_messages(outbox: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """OBX-04: the outbox after claiming planned messages; a message is claimed whole or not at all.

    plans: message_id, alert_id. Every member must be in the outbox, pending and never
    tried; the members of a claimed message carry its id and one attempt.
    """
    free = (F.col("state") == "PENDING") & (F.coalesce("automatic_attempts", F.lit(0)) == 0)
    met = plans.select("message_id", "alert_id").distinct().join(outbox.select("alert_id", free.alias("free")), "alert_id", "left")
    whole = met.groupBy("message_id").agg(F.bool_and(F.coalesce("free", F.lit(False))).alias("whole")).where("whole").select("message_id")
    # An alert in two messages is the first one's.
    taken = met.join(whole, "message_id").groupBy("alert_id").agg(F.min("message_id").alias("claimed_by"))
    known = outbox.drop("claimed_by").join(taken, "alert_id", "left")
    mine = F.col("claimed_by").isNotNull()
    return known.withColumns({"state": F.when(mine, "SENDING").otherwise(F.col("state")), "sending_at": F.when(mine, now).otherwise(F.col("sending_at")), "automatic_attempts": F.when(mine, 1).otherwise(F.coalesce("automatic_attempts", F.lit(0))), "message_id": F.coalesce("claimed_by", "message_id")}).drop("claimed_by")


def settle(outbox: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """OBX-04: the outbox after the answers to claimed messages; one without an answer may have gone out and is never retried.

    results: message_id, state, provider_message_id, error (state null: the answer was lost).
    """
    told = results.groupBy("message_id").agg(F.max(F.struct("state", "provider_message_id", "error")).alias("answer"), F.lit(True).alias("asked"))
    known = outbox.join(told, "message_id", "left")
    sent = (F.col("state") == "SENDING") & F.coalesce("asked", F.lit(False))
    left = (F.col("state") == "SENDING") & ~F.coalesce("asked", F.lit(False))
    state = F.when(sent, F.coalesce("answer.state", F.lit("AMBIGUOUS"))).when(left, "AMBIGUOUS").otherwise(F.col("state"))
    error = F.when(sent & F.col("answer.state").isNull(), "TRANSPORT_RESPONSE_LOST").when(sent, redact(F.coalesce("answer.error", F.lit("")))).when(left, "INTERRUPTED_AFTER_SEND_CLAIM").otherwise(F.col("error"))
    number = F.when(sent, F.coalesce("answer.provider_message_id", F.lit(""))).otherwise(F.col("provider_message_id"))
    return known.withColumns({"sent_at": F.when(sent & (F.col("answer.state") == "SENT"), now).otherwise(F.col("sent_at")), "error": error, "provider_message_id": number, "state": state}).drop("answer", "asked")


def _short(x: Column) -> Column:
    """A number with as few digits as it needs, two at most."""
    return F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"\.?0+$", "")


def posting_line(posted: Column, first_seen: Column) -> Column:
    """When a record was posted, in Indian time, or when it was first seen."""
    local = lambda x: F.concat(F.date_format(F.from_utc_timestamp(x, IST), "yyyy-MM-dd HH:mm"), F.lit(" IST"))
    return F.when(posted.isNotNull(), F.concat(F.lit("posted "), local(posted))).otherwise(F.concat(F.lit("posting date unknown, first seen "), local(first_seen)))


def render_jobs(jobs: DataFrame) -> DataFrame:
    """OBX-05: (job_uid, text) of each scored record: what it is, why it counts, what is missing, what to do next.

    jobs: company, title, posted_at_source, first_seen_at, identities, apply_url,
    fit_score, priority_score, reasons, gaps, action_by, next_action, salary_currency,
    salary_min, salary_max, salary_period, posted_at_confidence, official_link_state.
    """
    ids = F.array_join(F.filter(F.transform("identities", lambda i: i["provider_job_id"]), lambda x: x != ""), ", ")
    pay = F.when(F.col("salary_min").isNotNull(), F.concat_ws(" ", "salary_currency", F.concat(_short(F.col("salary_min")), F.lit(" to "), _short(F.col("salary_max"))), "salary_period")).otherwise("not disclosed")
    lines = (
        F.concat("company", F.lit(": "), "title"), posting_line(F.col("posted_at_source"), F.col("first_seen_at")), F.concat(F.lit("ids: "), F.coalesce(F.nullif(ids, F.lit("")), F.lit("none"))), F.concat(F.lit("apply at: "), F.coalesce("apply_url", F.lit(""))),
        F.concat(F.lit("fit "), _short(F.col("fit_score")), F.lit(", priority "), _short(F.col("priority_score"))), F.concat(F.lit("for: "), F.array_join(F.slice("reasons", 1, 3), "; ")), F.concat(F.lit("gaps: "), F.coalesce(F.nullif(F.array_join("gaps", "; "), F.lit("")), F.lit("none recorded"))),
        F.concat(F.lit("act by "), F.coalesce("action_by", F.lit("")), F.lit(", next: "), F.coalesce("next_action", F.lit(""))), F.concat(F.lit("pay: "), pay), F.concat(F.lit("dated "), "posted_at_confidence", F.lit(", link "), "official_link_state"),
    )
    return jobs.select("job_uid", F.concat_ws("\n", *lines).alias("text"))


def render_digests(entries: DataFrame, group: str, top: int = 20) -> DataFrame:
    """OBX-05, SRT-05: (group, n_entries, text): the first entries of each digest and how many are left out.

    entries: group, part (its place among the parts of a digest), score, uid, line. Parts
    come in order, then higher scores, then uids. Only ``top`` entries of a group are
    ever put together; the others are counted.
    """
    order = ["part", F.desc_nulls_last("score"), "uid"]
    first = entries.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= top)
    counts = entries.groupBy(group).agg(F.count("*").alias("n_entries"))
    joined = first.groupBy(group).agg(F.expr("listagg(line, '\n\n') within group (order by place)").alias("body"))
    rest = F.col("n_entries") - top
    footer = F.when(rest > 0, F.concat(F.lit("\n\n"), rest.cast("string"), F.lit(" more"))).otherwise("")
    return counts.join(joined, group).select(group, "n_entries", F.concat("body", footer).alias("text"))
