"""Queries that run the gates and transitions of sources, contacts and versions over the driver's tables; ids decide the states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import dates
from tarnwick.operators import contacts, digest, lifecycle, outbox, planner, reports, workflow
from tarnwick.plans.ledgers import NOW, _SQL_NOW, _iso, _now, _pick, _seconds, _sql_pick
from tarnwick.sources import boards
from tarnwick.tables import read_table

_MODES = ("OFFICIAL_API", "RSS_ATOM", "PUBLIC_HTML_APPROVED", "MANUAL")
_HEALTH = ("HEALTHY", "UNKNOWN", "DOWN", "DEGRADED", "PAUSED", "STALE", "HEALTHY")


def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-01: events as sources, each field open or failing by the id."""
    n = F.col("event_id")
    none = F.lit(None).cast("timestamp_ntz")
    sources = read_table(spark, sf_dir, "events").select(
        "event_id", (n % 29 != 0).alias("enabled"), F.when(n % 31 != 0, "APPROVED").alias("policy_state"), _pick(_MODES, n).alias("access_mode"), F.when(n % 23 == 0, "UNVERIFIED").when(n % 2 == 0, "VERIFIED_ACTIVE").otherwise("VERIFIED_EMPTY").alias("coverage_state"), _pick(_HEALTH, n).alias("health_state"),
        F.when(n % 17 == 0, F.timestamp_add("HOUR", F.lit(1), _now())).when(n % 3 == 0, _now()).otherwise(none).alias("backoff_until"), F.when(n % 19 == 0, "paid").otherwise("free").alias("cost_class"), F.when(n % 37 != 0, F.col("ts")).alias("policy_reviewed_at"),
        F.timestamp_add("DAY", F.lit(14), F.col("ts")).alias("policy_review_due_at"), F.lit("https://example.org/terms").alias("policy_evidence_url"), F.when(n % 41 != 0, "hash").otherwise("").alias("policy_evidence_hash"), F.lit("owner").alias("human_reviewer"),
        F.when(n % 5 != 0, n % 10 < 7).alias("robots_allowed"), F.array(F.lit("example.org"), F.when(n % 13 != 0, F.lit("jobs.example.org"))).alias("allowed_hosts"),
    )
    return sources.select("event_id", planner.policy_reason(F.lit("jobs.example.org"), _now()).alias("reason"))


POLICY_GATE = f"""
select event_id, case when event_id % 29 = 0 or event_id % 31 = 0 then 'SOURCE_NOT_APPROVED' when event_id % 4 = 3 then 'ACCESS_MODE_NOT_AUTOMATED' when event_id % 23 = 0 then 'SOURCE_NOT_VERIFIED'
  when event_id % 7 in (2, 4) then 'SOURCE_HEALTH_BLOCKED' when event_id % 17 = 0 then 'BACKOFF_ACTIVE' when event_id % 19 = 0 then 'ZERO_COST_REJECTED'
  when event_id % 37 = 0 or event_id % 41 = 0 or ts > {_SQL_NOW} or ts + interval 14 day <= {_SQL_NOW} then 'POLICY_EVIDENCE_MISSING_OR_OVERDUE'
  when event_id % 4 in (1, 2) and (event_id % 5 = 0 or event_id % 10 >= 7) then 'ROBOTS_NOT_APPROVED' when event_id % 13 = 0 then 'UNAPPROVED_HOST' end as reason
from events
"""

_OUTCOMES = ("SUCCESS_COMPLETE", "SUCCESS_EMPTY", "NO_CHANGE", "PARTIAL_BUDGET", "FETCH_FAILED", "BACKOFF", "POLICY_BLOCKED", "AUTH_REQUIRED", "PAUSE", "REPAIR", "DEFERRED_BUDGET", "UNPAUSE", "PARSE_FAILED")


def source_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-08, STM-09, STM-12: events as sources, each with one outcome."""
    n = F.col("event_id")
    hours = lambda h: F.timestamp_add("HOUR", h, _now())
    sources = read_table(spark, sf_dir, "events").select(
        "event_id", _pick(_OUTCOMES, n).alias("outcome"), (n % 3 != 0).alias("complete"), F.when(n % 2 == 0, hours((n % 7 - 3).cast("int"))).alias("new_backoff"), (n % 17 == 0).alias("anomaly"), (n % 19 != 0).alias("enabled"), _pick(("HEALTHY", "DEGRADED", "PAUSED", "AUTH_REQUIRED", "UNKNOWN"), n).alias("health_state"),
        F.when(n % 4 != 0, F.col("ts")).alias("last_success_at"), (n % 4).cast("int").alias("consecutive_failures"), F.when(n % 9 == 0, hours(F.lit(2))).alias("backoff_until"), (n % 48 + 1).cast("int").alias("cadence_hours"), _pick(("NONE", "IN_PROGRESS", "COMPLETED"), n).alias("baseline_state"),
        F.lit(None).cast("timestamp_ntz").alias("last_attempt_at"), hours(F.lit(-1)).alias("next_due_at"), F.lit("APPROVED").alias("policy_state"), F.lit("").alias("last_outcome"),
    )
    after = planner.finish(sources, _now())
    at = lambda c: _seconds(F.col(c)).alias(c.removesuffix("_at") + "_second")
    return after.select("event_id", "health_state", "baseline_state", "policy_state", "last_outcome", F.col("consecutive_failures").cast("long").alias("failures"), at("last_attempt_at"), at("last_success_at"), at("next_due_at"), at("backoff_until"))


SOURCE_TRANSITIONS = f"""
with s as (
  select event_id, {_sql_pick(_OUTCOMES, "event_id")} as outcome, event_id % 3 <> 0 as complete, case when event_id % 2 = 0 then {_SQL_NOW} + to_hours(cast(event_id % 7 - 3 as int)) end as new_backoff, event_id % 17 = 0 as anomaly, event_id % 19 <> 0 as enabled,
    {_sql_pick(("HEALTHY", "DEGRADED", "PAUSED", "AUTH_REQUIRED", "UNKNOWN"), "event_id")} as health, case when event_id % 4 <> 0 then ts end as success, event_id % 4 as failures, case when event_id % 9 = 0 then {_SQL_NOW} + interval 2 hour end as backoff, event_id % 48 + 1 as cadence,
    {_sql_pick(("NONE", "IN_PROGRESS", "COMPLETED"), "event_id")} as baseline
  from events),
kind as (
  select *, case when outcome = 'POLICY_BLOCKED' then 'stop' when outcome = 'BACKOFF' then 'wait' when outcome = 'AUTH_REQUIRED' then 'auth' when outcome = 'PAUSE' then 'pause' when outcome in ('UNPAUSE', 'REPAIR') then 'repair' when outcome = 'DEFERRED_BUDGET' then 'skip'
    when anomaly then 'bad' when outcome = 'PARTIAL_BUDGET' then 'partial' when outcome in ('SUCCESS_COMPLETE', 'SUCCESS_EMPTY', 'NO_CHANGE') then case when complete then 'good' else 'partial' end else 'bad' end as kind from s),
odd as (select *, anomaly and kind = 'bad' as odd from kind),
step as (
  select *, case when kind in ('repair', 'good') then 0 when kind = 'bad' and not odd then failures + 1 else failures end as failures2,
    case when kind in ('repair', 'good') then null when kind = 'wait' then case when new_backoff > {_SQL_NOW} then new_backoff else {_SQL_NOW} + interval 60 second end when kind = 'bad' and not odd then coalesce(new_backoff, backoff) else backoff end as backoff2,
    case when kind = 'repair' then null when kind = 'good' then {_SQL_NOW} else success end as success2 from odd),
aged as (select *, coalesce((epoch_us({_SQL_NOW}) - epoch_us(success2)) / 3.6e9, 0) as age from step)
select event_id, case when kind = 'auth' then 'AUTH_REQUIRED' when kind = 'pause' then 'PAUSED' when kind = 'repair' then 'UNKNOWN' when kind = 'good' then 'HEALTHY' when kind in ('stop', 'partial') then health
    when not enabled or health = 'PAUSED' then 'PAUSED' when health = 'AUTH_REQUIRED' then 'AUTH_REQUIRED' when failures2 >= 3 or age > 4 * cadence then 'DOWN' when age > 2 * cadence then 'STALE' when coalesce(backoff2 > {_SQL_NOW}, false) then 'BACKOFF'
    when odd or failures2 > 0 then 'DEGRADED' when success2 is not null then 'HEALTHY' else 'UNKNOWN' end as health_state,
  case when kind = 'good' then 'COMPLETED' when kind = 'partial' and baseline <> 'COMPLETED' then 'IN_PROGRESS' else baseline end as baseline_state, case when kind = 'stop' then outcome else 'APPROVED' end as policy_state,
  case when kind = 'partial' then 'PARTIAL_BUDGET' else outcome end as last_outcome, failures2 as failures, case when kind not in ('pause', 'repair', 'skip') then epoch_us({_SQL_NOW}) // 1000000 end as last_attempt_second, epoch_us(success2) // 1000000 as last_success_second,
  epoch_us(case when kind = 'good' then {_SQL_NOW} + to_hours(cast(cadence as int)) else {_SQL_NOW} - interval 1 hour end) // 1000000 as next_due_second, epoch_us(backoff2) // 1000000 as backoff_until_second
from aged
"""

_REPLIES = ("NONE", "NO_REPLY", "REPLIED", "NONE")


def contact_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-04, CTC-02: events as contacts; a first message, one with a reason, and a follow-up."""
    n = F.col("event_id")
    known = read_table(spark, sf_dir, "events").select(
        "event_id", (n % 11 == 0).alias("do_not_contact"), F.when(n % 13 != 0, n % 7 != 0).alias("outreach_allowed"), _pick(_REPLIES, n).alias("reply_state"), F.when(n % 17 == 0, _now()).alias("retention_expires_at"), _pick(("USER_CSV", "PUBLIC_PAGE", None), n).alias("contact_origin"),
        F.when(n % 5 == 0, "EXPLICIT_RECRUITING_CHANNEL:page").alias("contactability_basis"), F.when(n % 3 != 1, F.timestamp_add("DAY", F.lit(-15), F.col("ts"))).alias("last_contacted_at"), F.when(n % 4 != 0, n % 2).alias("follow_up_count"), F.when(n % 2 == 0, " agreed ").otherwise(" ").alias("why"),
    )
    return known.select("event_id", contacts.can_contact(_now()).alias("first"), contacts.can_contact(_now(), override_reason=F.col("why")).alias("with_reason"), contacts.can_contact(_now(), follow_up=True).alias("follow_up"))


CONTACT_GATE = f"""
with c as (select event_id, event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 7 <> 0 and event_id % 4 <> 2 and event_id % 17 <> 0 and (event_id % 3 = 0 or event_id % 5 = 0) as allowed, case when event_id % 3 <> 1 then ts - interval 15 day end as last from events)
select event_id, allowed and not coalesce(last > {_SQL_NOW} - interval 30 day, false) as first, allowed and (event_id % 2 = 0 or not coalesce(last > {_SQL_NOW} - interval 30 day, false)) as with_reason,
  allowed and (event_id % 4 = 0 or event_id % 2 = 0) and coalesce({_SQL_NOW} >= last + to_days(cast(case isodow(last) when 6 then 6 when 7 then 5 else 7 end as int)), false) as follow_up
from c
"""


def record_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDP-09, STM-11: order lines before and after; the first rule that holds names the event."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    states = ("ACTIVE", "REOPENED", "CLOSED", "POSSIBLY_CLOSED")
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", _pick(states, k).alias("old_active_state"), _pick(states, k + F.when(n % 3 == 0, n).otherwise(0)).alias("active_state"), F.lit("a").alias("old_apply_url"), F.when((k + n) % 11 != 0, "a").alias("apply_url"),
        F.when(k % 2 == 0, F.col("l_shipdate")).alias("old_deadline"), F.when(n % 4 == 0, F.timestamp_add("DAY", (k % 5 - 2).cast("int"), F.col("l_shipdate"))).alias("deadline"), F.col("l_returnflag").alias("old_location"), F.when(n % 5 == 0, F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("location"),
        F.lit(0).alias("old_min_years"), F.when(k % 7 == 0, 1).otherwise(0).alias("min_years"), F.lit(2).alias("old_max_years"), F.lit(2).alias("max_years"), F.lit("").alias("old_education_constraint"), F.lit("").alias("education_constraint"),
    )
    kind = digest.snapshot_kind(F.when(k % 3 != 0, k % 3 == 1), n % 2 == 0)
    return lines.groupBy(lifecycle.record_change_event().alias("event"), kind.alias("snapshot")).agg(F.count("*").alias("n"), F.sum(k * 10 + n).alias("keys"))


_LINE_STATES = ("ACTIVE", "REOPENED", "CLOSED", "POSSIBLY_CLOSED")
RECORD_EVENTS = f"""
with l as (select *, {_sql_pick(_LINE_STATES, "l_orderkey")} as old_state, {_sql_pick(_LINE_STATES, "(l_orderkey + case when l_linenumber % 3 = 0 then l_linenumber else 0 end)")} as state,
  case when l_linenumber % 4 = 0 then l_shipdate + to_days(cast(l_orderkey % 5 - 2 as int)) end as deadline, case when l_orderkey % 2 = 0 then l_shipdate end as old_deadline from lineitem)
select case when state in ('REOPENED', 'CLOSED') and state <> old_state then state when (l_orderkey + l_linenumber) % 11 = 0 then 'APPLY_URL_REPLACED' when deadline is not null and (old_deadline is null or deadline < old_deadline) then 'EARLIER_DEADLINE'
    when l_linenumber % 5 = 0 and l_linestatus <> l_returnflag then 'LOCATION_CHANGED' when l_orderkey % 7 = 0 then 'ELIGIBILITY_CHANGED' else '' end as event,
  case when l_orderkey % 3 <> 1 then 'BASELINE' when l_linenumber % 2 = 0 then 'FULL' else 'INCREMENTAL' end as snapshot, count(*) as n, cast(sum(l_orderkey * 10 + l_linenumber) as bigint) as keys
from l group by 1, 2
"""


def action_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-02, SRT-04/07, JON-08, PRD-07: orders as records; some have applications and drafts."""
    k = F.col("o_orderkey")
    orders = read_table(spark, sf_dir, "orders").select(k, "o_orderdate", k.cast("string").alias("job_uid"))
    day = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    jobs = orders.select("job_uid", _pick(("P0", "P1", "P2", "P3", "EXCLUDED", None), k).alias("action_priority"), day("o_orderdate").alias("action_by_ist"), F.when(k % 2 == 0, "read").alias("next_action"))
    twice = orders.where(k % 3 == 0).withColumn("pos", F.explode(F.sequence(F.lit(1), (k % 2 + 1).cast("int"))))
    applications = twice.select("job_uid", "pos", _pick(workflow.STAGES, k + F.col("pos")).alias("application_stage"), F.when(k % 5 == 0, "call").otherwise("").alias("next_step"), F.when(k % 4 == 0, day(F.timestamp_add("DAY", F.col("pos"), F.col("o_orderdate")))).alias("next_step_due"), _pick(workflow.REFERRAL, k).alias("referral_stage"))
    drafts = orders.where(k % 5 < 2).select("job_uid", k.alias("pos"), _pick(workflow.OUTREACH, k).alias("outreach_stage"), F.when(k % 2 == 0, "1996-06-01 09:00").alias("follow_up_due"))
    return reports.action_queue(jobs, applications, drafts, "1997-01-01 00:00")


ACTION_QUEUE = f"""
with app as (select o_orderkey, o_orderkey % 2 + 1 as pos, o_orderdate from orders where o_orderkey % 3 = 0),
joined as (
  select o.o_orderkey as k, {_sql_pick(("P0", "P1", "P2", "P3", "EXCLUDED", None), "o.o_orderkey")} as priority, strftime(o.o_orderdate, '%Y-%m-%d %H:%M') as by_then, case when pos is not null then {_sql_pick(workflow.STAGES, "(o.o_orderkey + pos)")} else 'NOT_STARTED' end as stage,
    case when pos is not null and o.o_orderkey % 4 = 0 then strftime(o.o_orderdate + to_days(cast(pos as int)), '%Y-%m-%d %H:%M') end as step_due, case when pos is not null and o.o_orderkey % 5 = 0 then 'call' end as step, case when pos is not null then {_sql_pick(workflow.REFERRAL, "o.o_orderkey")} else 'NOT_STARTED' end as referral_stage,
    case when o.o_orderkey % 5 < 2 then {_sql_pick(workflow.OUTREACH, "o.o_orderkey")} else '' end as outreach_stage, case when o.o_orderkey % 5 < 2 and o.o_orderkey % 2 = 0 then '1996-06-01 09:00' end as follow
  from orders o left join app using (o_orderkey)),
due as (select *, coalesce(step_due, follow, by_then) as due from joined where stage not in ({", ".join(map(repr, reports.SETTLED_STAGES))}) and coalesce(priority, 'P2') not in ('EXCLUDED', 'P3'))
select cast(k as varchar) as job_uid, coalesce(priority, 'P2') as action_priority, case when due[:16] < '1997-01-01 00:00' then 'OVERDUE' else '' end as overdue, due as action_by_ist, coalesce(step, case when k % 2 = 0 then 'read' end, '') as next_action, stage as application_stage, referral_stage, outreach_stage from due
"""


def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-05/06/08: weekday arithmetic, IST texts and summary windows of every event."""
    at = F.col("ts").cast("timestamp")
    window = dates.digest_window(at, F.col("event_id") % 2 == 0)
    return read_table(spark, sf_dir, "events").select("event_id", dates.business_days_after(F.to_date("ts")).alias("fifth_weekday"), dates.ist(at).alias("ist"), _seconds(window.cast("timestamp_ntz")).alias("window_second"))


DATE_RULES = """
select event_id, cast(ts as date) + cast(list_filter(range(1, 18), lambda d: isodow(cast(ts as date) + cast(d as int)) < 6)[5] as int) as fifth_weekday, strftime(ts + interval 330 minute, '%Y-%m-%d %H:%M IST') as ist,
  epoch_us(date_trunc('day', ts + interval 330 minute) + to_minutes(case when event_id % 2 = 0 then 1151 else 491 end) - interval 330 minute) // 1000000 as window_second
from events
"""


def due_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-07, DAT-09: due texts of four kinds; naive ones are never due."""
    n, at = F.col("event_id"), F.col("ts")
    text = F.when(n % 4 == 0, _iso(at)).when(n % 4 == 1, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(" IST"))).when(n % 4 == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    now = dates.instant(F.lit(NOW.replace(" ", "T") + "Z"))
    return read_table(spark, sf_dir, "events").select("event_id", dates.due_now(text, now).alias("due"), F.unix_micros(dates.instant(text)).alias("micros"))


DUE_TEXTS = f"""
select event_id, case event_id % 4 when 0 then ts <= {_SQL_NOW} when 1 then date_trunc('minute', ts) - interval 330 minute <= {_SQL_NOW} else false end as due, case when event_id % 4 = 0 then epoch_us(ts) end as micros from events
"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-05, HSH-06: versions of orders as records and as listings."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    o = read_table(spark, sf_dir, "orders").select(
        k, F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted_at_source"), F.lit("EXACT").alias("posted_at_confidence"), F.when(k % 3 != 0, F.concat(F.lit("https://example.org/"), text)).alias("apply_url"), F.col("o_orderstatus").alias("active_state"), F.when(k % 2 == 0, "2024-02-01").alias("deadline"),
        F.col("o_orderpriority").alias("location"), F.lit("ONSITE").alias("work_mode"), F.lit("").alias("visa_text"), (k % 4).alias("min_years"), F.lit(None).cast("long").alias("max_years"), F.lit("").alias("education_constraint"), (k % 6).alias("material_change_sequence"),
        text.alias("provider_job_id"), F.lit("t").alias("tenant"), F.lit("c").alias("company"), F.col("o_orderstatus").alias("title"), F.lit("https://example.org").alias("url"), _iso(F.col("o_orderdate")).alias("updated_at_raw"),
    )
    return o.select("o_orderkey", outbox.material_version().alias("material"), boards.listing_version("1").alias("listing"))


VERSIONS = """
with o as (select *, sha256('{"education_constraint":"","location":"' || o_orderpriority || '","max_years":null,"min_years":"' || o_orderkey % 4 || '","visa_text":"","work_mode":"ONSITE"}') as eligibility, case when o_orderkey % 3 <> 0 then sha256('https://example.org/' || o_orderkey) else '' end as url from orders)
select o_orderkey, sha256('{"active_state":"' || o_orderstatus || '","apply_url":"' || url || '","deadline":' || case when o_orderkey % 2 = 0 then '"2024-02-01"' else 'null' end || ',"description_sequence":' || o_orderkey % 6 || ',"eligibility":"' || eligibility
    || '","priority_transition":"","publication":"' || strftime(o_orderdate, '%Y-%m-%d') || '","publication_confidence":"EXACT","template":"v1"}') as material,
  sha256('{"company":"c","location":"' || o_orderpriority || '","parser":"1","provider_job_id":"' || o_orderkey || '","tenant":"t","title":"' || o_orderstatus || '","updated":' || epoch_us(o_orderdate) || ',"url":"https://example.org"}') as listing
from o
"""


def catalogue_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: pay and source figures, one row a figure."""
    k, n, none = F.col("o_orderkey"), F.col("event_id"), F.lit(None).cast("double")
    jobs = read_table(spark, sf_dir, "orders").select(
        F.when(k % 29 != 0, k.cast("string")).alias("job_uid"), F.when(k % 3 == 0, F.col("o_totalprice") * 10).alias("salary_base_min"), none.alias("salary_base_max"), F.when(k % 5 == 0, F.col("o_totalprice")).alias("salary_total_min"), none.alias("salary_total_max"), F.when(k % 7 != 0, "page").otherwise("").alias("salary_source"),
        _pick(("annual", "YEAR", "MONTH", None), k).alias("salary_period"), F.when(k % 11 != 0, "INR").alias("salary_currency"), _pick((*reports.SOURCED, "GUESSED"), F.floor(k / 4)).alias("salary_confidence"), _pick(("ACTIVE", "CLOSED", None), F.floor(k / 3)).alias("active_state"), _pick(("P0", "EXCLUDED", None, "P2"), F.floor(k / 12)).alias("action_priority"),
    )
    sources = read_table(spark, sf_dir, "events").select((n % 7 != 0).alias("enabled"), (n % 97).alias("cadence_hours"), F.when(n > 40, F.col("ts")).alias("last_success_at"))
    figures = lambda df: df.unpivot([], df.columns, "figure", "amount")
    pay = reports.pay_figures(jobs, 9.0).select("known_pay_rate", F.col("reach_target").cast("double").alias("reach_target"))
    last = reports.source_figures(sources, _now()).select(F.col("largest_cadence").cast("double").alias("largest_cadence"), "largest_age")
    return figures(pay).unionByName(figures(last)).withColumn("amount", F.round("amount", 6))


CATALOGUE_FIGURES = f"""
with pay as (
  select avg(cast((o_orderkey % 3 = 0 or o_orderkey % 5 = 0) and o_orderkey % 7 <> 0 as int)) as known_pay_rate, cast(count(*) filter (where o_orderkey % 3 = 0 and o_totalprice * 10 >= 900000 and o_orderkey % 7 <> 0 and o_orderkey % 4 < 2 and o_orderkey % 11 <> 0
    and (o_orderkey // 4) % 4 < 3 and (o_orderkey // 3) % 3 <> 1 and (o_orderkey // 12) % 4 <> 1) as double) as reach_target from orders where o_orderkey % 29 <> 0),
last as (select cast(max(event_id % 97) as double) as largest_cadence, max(case when event_id > 40 and ts <= {_SQL_NOW} then (epoch_us({_SQL_NOW}) - epoch_us(ts)) / 3.6e9 end) as largest_age from events where event_id % 7 <> 0)
select 'known_pay_rate' as figure, round(known_pay_rate, 6) as amount from pay union all select 'reach_target', reach_target from pay union all select 'largest_cadence', largest_cadence from last union all select 'largest_age', round(largest_age, 6) from last
"""

QUERIES = {f.__name__: f for f in (policy_gate, source_transitions, contact_gate, record_events, action_queue, date_rules, due_texts, versions, catalogue_figures)}
SQL = {
    "policy_gate": POLICY_GATE, "source_transitions": SOURCE_TRANSITIONS, "contact_gate": CONTACT_GATE, "record_events": RECORD_EVENTS, "action_queue": ACTION_QUEUE, "date_rules": DATE_RULES, "due_texts": DUE_TEXTS, "versions": VERSIONS, "catalogue_figures": CATALOGUE_FIGURES,
}
