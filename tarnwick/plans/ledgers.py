"""Queries that run the record rules (misses, facts, commands, alerts, gates) over the driver's tables; ids decide the states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import dates
from tarnwick.functions.hashing import digest
from tarnwick.operators import contacts, lifecycle, outbox, reports, workflow
from tarnwick.tables import read_table

NOW = "2024-01-20 00:00:00"
_SQL_NOW = f"timestamp '{NOW}'"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _pick(values: tuple[str | None, ...], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _sql_pick(values: tuple[str | None, ...], n: str) -> str:
    return f"([{', '.join('null' if v is None else repr(v) for v in values)}])[{n} % {len(values)} + 1]"


def _iso(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _seconds(x: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x)


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    u = F.col("user_id")
    return e.select(
        u, F.concat_ws(":", u.cast("string"), "event_type").alias("appearance_uid"), u.cast("string").alias("job_uid"), (F.col("last") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).alias("seen"), (u % 5 != 0).alias("eligible"),
        (u % 4).cast("int").alias("misses"), F.when(u % 3 != 0, F.timestamp_add("HOUR", F.lit(12), F.col("last"))).alias("last_missing_at"), _pick(("ACTIVE", "POSSIBLY_CLOSED", "CLOSED"), u).alias("active_state"),
    )


_PRESENCE = f"""
presence as (
  select user_id, user_id || ':' || event_type as appearance_uid, cast(user_id as varchar) as job_uid, max(ts) >= timestamp '2024-01-30' as seen, user_id % 5 <> 0 as eligible, user_id % 4 as misses,
    case when user_id % 3 <> 0 then max(ts) + interval 12 hour end as last_missing_at, {_sql_pick(("ACTIVE", "POSSIBLY_CLOSED", "CLOSED"), "user_id")} as active_state
  from events group by user_id, event_type)
"""
_LATE = "2024-01-31 06:00:00"


def _late() -> Column:
    return F.lit(_LATE).cast("timestamp_ntz")


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _presence(spark, sf_dir)
    return lifecycle.miss_counters(p.select("appearance_uid", "job_uid", "seen", "eligible"), p.where("user_id % 7 != 0").select("appearance_uid", "misses", "last_missing_at"), _late())


_COUNTERS = f"""
{_PRESENCE},
known as (select * replace (case when user_id % 7 = 0 then null else misses end as misses, case when user_id % 7 = 0 then null else last_missing_at end as last_missing_at) from presence),
told as (select *, not seen and eligible and (last_missing_at is null or epoch_us(timestamp '{_LATE}') - epoch_us(last_missing_at) >= 12 * 3600000000) as miss from known),
counted as (select appearance_uid, job_uid, case when seen then 0 when miss then coalesce(misses, 0) + 1 else coalesce(misses, 0) end as misses,
  case when seen then null when miss then timestamp '{_LATE}' else last_missing_at end as last_missing_at from told)
"""
_STATE = "case when misses >= 3 then 'CLOSED' when misses >= 2 then 'POSSIBLY_CLOSED' else 'ACTIVE' end"


def miss_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01, WIN-07: counters after one batch; misses count only 12 hours apart."""
    return _counters(spark, sf_dir).select("appearance_uid", "job_uid", F.col("misses").cast("long").alias("misses"), _seconds(F.col("last_missing_at")).alias("missing_second"))


MISS_BATCH = f"with {_COUNTERS} select appearance_uid, job_uid, misses, epoch_us(last_missing_at) // 1000000 as missing_second from counted"


def miss_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-02, AGG-12."""
    return lifecycle.closure(_counters(spark, sf_dir)).select("job_uid", F.col("misses").cast("long").alias("misses"), "state")


MISS_CLOSURE = f"with {_COUNTERS}, least as (select job_uid, min(misses) as misses from counted group by 1) select *, {_STATE} as state from least"


def missing_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-03: records taken alone."""
    c = F.col
    after = lifecycle.mark_missing(c("misses"), c("last_missing_at"), c("active_state"), _late(), c("eligible"), c("seen"), c("user_id") % 17 == 0)
    return _presence(spark, sf_dir).select("appearance_uid", after.alias("a")).select("appearance_uid", c("a.misses").cast("long").alias("misses"), _seconds(c("a.last_missing_at")).alias("missing_second"), c("a.active_state").alias("active_state"))


MISSING_ALONE = f"""
with {_PRESENCE},
due as (select *, user_id % 17 = 0 as closed, eligible and (last_missing_at is null or epoch_us(timestamp '{_LATE}') - epoch_us(last_missing_at) >= 12 * 3600000000) as due from presence)
select appearance_uid, case when seen then 0 when not closed and due then misses + 1 else misses end as misses,
  case when seen then null when not closed and due then epoch_us(timestamp '{_LATE}') // 1000000 else epoch_us(last_missing_at) // 1000000 end as missing_second,
  case when seen then case when active_state = 'ACTIVE' then 'ACTIVE' else 'REOPENED' end when closed then 'CLOSED' when due and misses + 1 >= 3 then 'CLOSED' when due and misses + 1 >= 2 then 'POSSIBLY_CLOSED' else active_state end as active_state
from due
"""


def facts_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-06, AGG-09/10, RPT-01: users as records; signups apply, clicks appear, purchases move stages, views are outreach."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.col("user_id").cast("string").alias("job_uid"))
    n, of = F.col("event_id"), lambda kind: e.where(F.col("event_type") == kind)
    jobs = e.groupBy("job_uid", "user_id").agg(F.min("event_type").alias("role_family"), _iso(F.min("ts")).alias("first_seen_at")).withColumns({"freshness_band": F.when(F.col("user_id") % 2 == 0, "HOT_0_6H").otherwise(""), "company": F.concat(F.lit("Co_"), (F.col("user_id") % 10).cast("string"))})
    applications = of("signup").select("job_uid", n.alias("pos"), F.when(n % 7 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(_iso(F.col("ts"))).alias("applied_at"), _pick(workflow.STAGES, n).alias("application_stage"))
    appearances = of("click").select("job_uid", n.alias("pos"), F.when(n % 5 != 0, F.concat(F.lit("src_"), (n % 4).cast("string"))).otherwise("").alias("source_id"))
    companies = spark.range(10).select(F.concat(F.lit("CO_"), F.col("id").cast("string")).alias("company"), F.when(F.col("id") != 7, F.col("id") % 4).alias("company_tier"), F.col("id").alias("pos"))
    moves = of("purchase").select("job_uid", _pick(workflow.STAGES, n).alias("to_stage"))
    sent = of("view").select("job_uid", _iso(F.col("ts")).alias("sent_at"), _pick(("REPLIED", "SENT_MANUALLY", "DRAFTED"), n).alias("outreach_stage"), _pick(("received", None, "", "OPEN"), n).alias("reply_state"))
    facts = reports.record_facts(jobs, applications, appearances, companies, moves, sent, dates.instant(F.lit(NOW.replace(" ", "T") + "Z")))
    return facts.withColumn("apply_hours", F.round("apply_hours", 6))


_IN = lambda values: ", ".join(map(repr, values))
FACTS_BY_RECORD = f"""
with jobs as (select user_id, min(event_type) as role, min(ts) as first_seen from events group by 1),
app as (select user_id, case when event_id % 7 <> 0 then ts end as applied_at, {_sql_pick(workflow.STAGES, "event_id")} as stage from events where event_type = 'signup' qualify row_number() over (partition by user_id order by event_id desc) = 1),
seen as (select user_id, case when event_id % 5 = 0 then 'UNATTRIBUTED' else 'src_' || event_id % 4 end as source from events where event_type = 'click' qualify row_number() over (partition by user_id order by event_id) = 1),
moves as (select user_id, list({_sql_pick(workflow.STAGES, "event_id")}) as past from events where event_type = 'purchase' group by 1),
outreach as (select user_id, count(*) as sent, count(*) filter (where event_id % 3 = 0 or event_id % 4 = 0) as replied from events where event_type = 'view' and ts <= {_SQL_NOW} group by 1),
joined as (select *, coalesce(applied_at <= {_SQL_NOW}, false) as applied, list_append(coalesce(past, []), coalesce(stage, '')) as stages from jobs left join app using (user_id) left join seen using (user_id) left join moves using (user_id) left join outreach using (user_id))
select cast(user_id as varchar) as job_uid, coalesce(source, 'UNATTRIBUTED') as source, role, case when user_id % 10 = 7 then 'UNASSIGNED' else 'Tier ' || (user_id % 10) % 4 end as tier, case when user_id % 2 = 0 then 'HOT_0_6H' else 'UNKNOWN' end as freshness_band,
  applied, applied and list_has_any(stages, [{_IN(reports.INTERVIEW_STAGES)}]) as interviewed, applied and list_has_any(stages, [{_IN(reports.OFFER_STAGES)}]) as offered, applied and list_contains(stages, 'ACCEPTED') as accepted,
  case when applied and applied_at >= first_seen then round((epoch_us(applied_at) - epoch_us(first_seen)) / 3.6e9, 6) end as apply_hours, coalesce(sent, 0) as sent, coalesce(replied, 0) as replied
from joined
"""


def command_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WFL-01, WFL-02: events as commands on the stages of an application, folded in order of event."""
    n = F.col("event_id")
    commands = read_table(spark, sf_dir, "events").select(
        n.alias("row_pos"), F.col("user_id").cast("string").alias("job_uid"), F.concat_ws(":", F.col("user_id").cast("string"), (n % 400).cast("string")).alias("event_uid"), F.when(n % 11 == 0, "").otherwise(_pick(workflow.STAGES, n * 7)).alias("application_stage_update"),
        F.when(n % 13 == 0, "UNHEARD_OF").otherwise("").alias("referral_stage_update"), F.lit("").alias("outreach_stage_update"), F.when(n % 5 == 0, "CORRECTION: mistyped").when(n % 3 == 0, "not for me").otherwise("").alias("reason"), F.when(n % 19 == 0, "UNKNOWN_JOB_UID").alias("result"),
    )
    u = F.col("user_id")
    started = read_table(spark, sf_dir, "events").select("user_id").distinct().where(u % 3 != 0).select(u.cast("string").alias("job_uid"), _pick(workflow.STAGES, u).alias("application_stage"))
    return workflow.replay(spark, commands, started).select("row_pos", "job_uid", "from_stage", "to_stage", "result")


_PLACE = f"list_position([{_IN(workflow.STAGES)}], %s)"
COMMAND_REPLAY = f"""
with recursive commands as (
  select event_id as row_pos, user_id, user_id || ':' || event_id % 400 as event_uid, case when event_id % 11 = 0 then '' else {_sql_pick(workflow.STAGES, "(event_id * 7)")} end as wanted, event_id % 13 = 0 as odd,
    event_id % 5 = 0 as correction, event_id % 5 = 0 or event_id % 3 = 0 as reasoned, case when event_id % 19 = 0 then 'UNKNOWN_JOB_UID' end as early, row_number() over (partition by user_id order by event_id) as k
  from events),
fold as (
  select user_id, cast(0 as bigint) as k, case when user_id % 3 = 0 then 'NOT_REVIEWED' else {_sql_pick(workflow.STAGES, "user_id")} end as stage, cast([] as varchar[]) as done, cast(null as bigint) as row_pos, cast(null as varchar) as from_stage, cast(null as varchar) as to_stage, cast(null as varchar) as result
  from events group by user_id
  union all
  select user_id, k, case when outcome = 'APPLIED' then after else stage end, case when outcome = 'APPLIED' then list_append(done, event_uid) else done end, row_pos, stage, case when outcome = 'APPLIED' then after end, outcome
  from (
    select *, case when early is not null then early when list_contains(done, event_uid) then 'REPLAY' when odd or (after = 'SKIPPED' and not reasoned) then 'INVALID_TRANSITION' when correction then 'APPLIED'
      when {_PLACE % "stage"} > 11 then case when after = stage then 'APPLIED' else 'INVALID_TRANSITION' end
      when {_PLACE % "stage"} <= 4 then case when after in ('ACCEPTED', 'DECLINED') then 'INVALID_TRANSITION' else 'APPLIED' end
      when {_PLACE % "after"} > 4 then 'APPLIED' else 'INVALID_TRANSITION' end as outcome
    from (select c.*, f.stage, f.done, coalesce(nullif(c.wanted, ''), f.stage) as after from fold f join commands c on c.user_id = f.user_id and c.k = f.k + 1)))
select row_pos, cast(user_id as varchar) as job_uid, from_stage, to_stage, result from fold where k > 0
"""

_PRIORITIES = ("P0", "P1", "P0", "PIPELINE", "EXCLUDED", "P2")
_CHANGES = (*outbox.UPDATE_EVENTS, "SKILLS_CHANGED")


def alert_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OBX-01, OBX-03, PRD-05: orders as records with alerts told before and changes since."""
    k = F.col("o_orderkey")
    orders = read_table(spark, sf_dir, "orders").select(k, "o_totalprice", "o_orderdate", "o_orderpriority", k.cast("string").alias("job_uid"))
    jobs = orders.select(
        "job_uid", F.col("o_totalprice").alias("priority_score"), _pick(_PRIORITIES, k).alias("action_priority"), F.when(k % 23 == 0, "ODD").alias("quarantine_reason"), (k % 5 < 3).alias("baseline"), F.when(k % 4 != 0, F.col("o_orderdate")).alias("posted_at_source"),
        F.when(k % 9 != 0, (k % 100).cast("double")).alias("age_hours_max"), F.col("o_orderpriority").alias("material_version"),
    )
    repeated = digest(job=F.col("job_uid"), type=F.lit("UPDATE"), version=F.col("o_orderpriority"))
    existing = orders.where(k % 7 < 3).select(F.when(k % 7 == 0, repeated).otherwise(F.concat(F.lit("old_"), "job_uid")).alias("alert_id"), "job_uid", _pick(("P0", "UPDATE", "DIGEST"), k).alias("alert_type"))
    changes = orders.where(k % 2 == 0).select("job_uid", _pick(_CHANGES, F.floor(k / 2)).alias("event"))
    return outbox.decisions(jobs, existing, changes)


ALERT_DECISIONS = f"""
with jobs as (select *, cast(o_orderkey as varchar) as job_uid, {_sql_pick(_PRIORITIES, "o_orderkey")} as action_priority from orders),
told as (select *, o_orderkey % 7 < 3 and o_orderkey % 3 < 2 as told, case when o_orderkey % 2 = 0 then {_sql_pick(_CHANGES, "(o_orderkey // 2)")} end as event from jobs),
due as (select *, told and coalesce(event in ({_IN(outbox.UPDATE_EVENTS)}), false) as is_update, o_orderkey % 5 < 3 and (o_orderkey % 4 = 0 or o_orderkey % 9 = 0 or o_orderkey % 100 > 48) as old_news from told),
named as (select *, case when is_update then 'UPDATE' else 'P0' end as alert_type from due where action_priority not in ('PIPELINE', 'EXCLUDED') and o_orderkey % 23 <> 0 and (is_update or (action_priority = 'P0' and not told and not old_news)))
select sha256('{{"job":"' || job_uid || '","type":"' || alert_type || '","version":"' || o_orderpriority || '"}}') as alert_id, job_uid, alert_type, o_orderpriority as material_version, o_totalprice as priority_score
from named where not (o_orderkey % 7 = 0 and alert_type = 'UPDATE')
"""

_SENDING = ("PENDING", "SENDING", "SENT")


def outbox_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OBX-04."""
    n = F.col("event_id")
    box = read_table(spark, sf_dir, "events").select("event_id", _pick(_SENDING, n).alias("state"), F.when(n % 3 != 0, F.col("ts")).alias("sending_at"))
    return outbox.claim(box, _now()).select("event_id", "state", _seconds(F.col("sending_at")).alias("sending_second"))


OUTBOX_CLAIM = f"""
select event_id, (['SENDING', 'AMBIGUOUS', 'SENT'])[event_id % 3 + 1] as state, epoch_us(case when event_id % 3 = 0 then {_SQL_NOW} else ts end) // 1000000 as sending_second from events
"""

_ORIGINS, _RELATIONS = ("USER_CSV", "GOOGLE_CONTACTS_EXPORT", "PUBLIC_PAGE", "UNKNOWN"), ("CLOSE_CONNECTION", "FIRST_DEGREE_IMPORTED", "AGREED_REFERRAL", "OTHER", "FORMER_COLLEAGUE")


def contact_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTC-01, JON-03, WIN-01/03: suppliers as records, customers of their nation as contacts; the best forty."""
    k = F.col("c_custkey")
    people = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("contact_"), k.cast("string")).alias("contact_uid"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"), F.lit(" Pvt Ltd")).alias("company"), (k % 11 == 0).alias("do_not_contact"), F.when(k % 13 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("retention_expires_at"),
        _pick(_ORIGINS, k).alias("contact_origin"), F.when(k % 6 != 0, "USER_SUPPLIED_CURRENT").otherwise("UNKNOWN").alias("current_company_confidence"), F.timestamp_add("DAY", (-(k % 200)).cast("int"), _now()).alias("evidence_fetched_at"),
        F.when(k % 8 == 2, "EXPLICIT_RECRUITING_CHANNEL: page").alias("contactability_basis"), _pick(_RELATIONS, k).alias("relationship_basis"), F.when(k % 3 == 0, "https://example.org/in").alias("linkedin_url"), F.when(k % 3 == 1, "a@example.org").alias("work_email"), (k % 2 == 0).alias("whatsapp_allowed"),
    )
    jobs = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("job_uid"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("normalized_company"))
    return contacts.rank_contacts(jobs, people, _now(), top=40).select("job_uid", "contact_uid", F.col("strength").cast("long").alias("strength"), "candidate_type", "recommended_channel", F.col("rank").cast("long").alias("rank"), "why", "agreed")


CONTACT_RANKS = f"""
with people as (
  select c_nationkey, 'contact_' || c_custkey as contact_uid, c_custkey % 4 < 2 as own, c_custkey % 6 <> 0 and c_custkey % 200 <= 180 as fresh, {_sql_pick(_RELATIONS, "c_custkey")} as relation, c_custkey % 8 = 2 as open_channel,
    case when c_custkey % 3 = 0 then 'LINKEDIN' when c_custkey % 3 = 1 then 'EMAIL' when c_custkey % 2 = 0 then 'WHATSAPP' else '' end as recommended_channel
  from customer where c_custkey % 11 <> 0 and c_custkey % 13 <> 0),
told as (select *, case when own and fresh then case when relation in ('CLOSE_CONNECTION', 'FORMER_COLLEAGUE') then 0 when relation = 'FIRST_DEGREE_IMPORTED' then 1 else 2 end when not own and open_channel then 3 end as strength,
  case when own then case when relation = 'AGREED_REFERRAL' then 'CONFIRMED_REFERRER' else 'WARM_CONNECTION' end else 'PERMITTED_RECRUITER' end as candidate_type,
  case when own then 'OWN_RELATIONSHIP:' || relation else 'EXPLICIT_RECRUITING_CHANNEL: page' end as why, own and relation = 'AGREED_REFERRAL' as agreed from people)
select cast(s_suppkey as varchar) as job_uid, contact_uid, strength, candidate_type, recommended_channel, why, agreed, row_number() over (partition by s_suppkey order by strength, contact_uid) as rank
from supplier join told on s_nationkey = c_nationkey where strength is not null qualify rank <= 40
"""

QUERIES = {f.__name__: f for f in (miss_batch, miss_closure, missing_alone, facts_by_record, command_replay, alert_decisions, outbox_claim, contact_ranks)}
SQL = {
    "miss_batch": MISS_BATCH, "miss_closure": MISS_CLOSURE, "missing_alone": MISSING_ALONE, "facts_by_record": FACTS_BY_RECORD, "command_replay": COMMAND_REPLAY, "alert_decisions": ALERT_DECISIONS, "outbox_claim": OUTBOX_CLAIM, "contact_ranks": CONTACT_RANKS,
}
