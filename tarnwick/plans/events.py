"""Queries over the event table: an entity is a user's day, its first event its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.functions import dates
from tarnwick.operators import digest, lifecycle, outbox, planner, reports
from tarnwick.operators.ordered import numbered
from tarnwick.tables import read_table

NOW = "2024-01-31 00:00:00"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(*columns)


def _epoch(x: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x)


def _user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each (user, day): one aggregation, ordered minima instead of windows."""
    e = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    at = F.struct("ts", "event_id")
    is_ = lambda t: F.col("event_type") == t
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.min_by("event_type", at).alias("source"), F.max_by("event_type", at).alias("role"), F.min("ts").alias("first_seen"),
        F.min(F.when(is_("signup"), F.col("ts"))).alias("applied_at"), F.count_if(is_("purchase")).alias("purchases"), F.count_if(is_("click")).alias("sent"), F.count_if(is_("view")).alias("replied"),
    )
    applied = F.col("applied_at").isNotNull()
    return days.select(
        "user_id", "day", "source", "role", F.when(F.col("user_id") % 3 == 0, "UNASSIGNED").otherwise(F.concat(F.lit("Tier "), (F.col("user_id") % 3).cast("string"))).alias("tier"),
        applied.alias("applied"), (applied & (F.col("purchases") > 0)).alias("interviewed"), (applied & (F.col("purchases") > 1)).alias("offered"), (applied & (F.col("purchases") > 2)).alias("accepted"),
        dates.hours_between(F.col("first_seen"), F.col("applied_at")).alias("apply_hours"), "sent", "replied",
    )


_DAYS = """
days as (
  select user_id, cast(ts as date) as day, arg_min(event_type, (ts, event_id)) as source, arg_max(event_type, (ts, event_id)) as role, min(ts) as first_seen,
    min(ts) filter (where event_type = 'signup') as applied_at, count(*) filter (where event_type = 'purchase') as purchases,
    count(*) filter (where event_type = 'click') as sent, count(*) filter (where event_type = 'view') as replied
  from events group by 1, 2),
facts as (
  select *, case when user_id % 3 = 0 then 'UNASSIGNED' else 'Tier ' || (user_id % 3) end as tier, applied_at is not null as applied,
    applied_at is not null and purchases > 0 as interviewed, applied_at is not null and purchases > 1 as offered, applied_at is not null and purchases > 2 as accepted,
    (epoch_us(applied_at) - epoch_us(first_seen)) / 3.6e9 as apply_hours
  from days)
"""


def funnel_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-01, AGG-06/08/22: cohorts by source, role and tier."""
    found = reports.cohorts(_user_days(spark, sf_dir))
    return found.select("dimension", "label", "applications", "interviews", "sent", "replied", F.round("interview_rate", 8).alias("interview_rate"), F.round("reply_rate", 8).alias("reply_rate"))


FUNNEL_COHORT = f"""
with {_DAYS},
long as (
  select 'source' as dimension, source as label, * from facts union all
  select 'role', role, * from facts union all
  select 'tier', tier, * from facts)
select dimension, label, count(*) filter (where applied) as applications, count(*) filter (where interviewed) as interviews, cast(sum(sent) as bigint) as sent, cast(sum(replied) as bigint) as replied,
  round(count(*) filter (where interviewed) / nullif(count(*) filter (where applied), 0), 8) as interview_rate, round(sum(replied) / nullif(sum(sent), 0), 8) as reply_rate
from long group by dimension, label
"""


def funnel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06."""
    return reports.funnel(_user_days(spark, sf_dir))


FUNNEL_TOTALS = f"""
with {_DAYS}
select count(*) filter (where applied) as applications, count(*) filter (where interviewed) as interviews, count(*) filter (where offered) as offers, count(*) filter (where accepted) as accepted from facts
"""


def median_time_to_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, AGG-20."""
    found = reports.apply_hours(_user_days(spark, sf_dir), "source")
    return found.select("source", F.round("median_apply_hours", 6).alias("median_apply_hours"), "median_samples")


MEDIAN_TIME_TO_APPLY = f"""
with {_DAYS}
select source, round(median(apply_hours), 6) as median_apply_hours, count(apply_hours) as median_samples from facts group by source
"""


def calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05, AGG-17, PRD-12: today, this ISO week and this month in IST, the future excluded."""
    local = lambda x: F.timestamp_add("MINUTE", F.lit(330), x)
    day, now_day = F.to_date(local(F.col("ts"))), F.to_date(local(_now()))
    monday = lambda d: F.date_sub(d, F.weekday(d))
    past = F.col("ts") <= _now()
    e = _events(spark, sf_dir, "ts", "event_type")
    return e.groupBy("event_type").agg(
        F.count_if(past & (day == now_day)).alias("today"), F.count_if(past & (monday(day) == monday(now_day))).alias("this_week"),
        F.count_if(past & (F.trunc(day, "month") == F.trunc(now_day, "month"))).alias("this_month"),
    )


CALENDAR_WINDOWS = f"""
with local as (select event_type, ts, ts + interval 330 minute as t, timestamp '{NOW}' + interval 330 minute as n from events where ts <= timestamp '{NOW}')
select event_type, count(*) filter (where cast(t as date) = cast(n as date)) as today,
  count(*) filter (where date_trunc('week', t) = date_trunc('week', n)) as this_week, count(*) filter (where date_trunc('month', t) = date_trunc('month', n)) as this_month
from local group by event_type
"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _events(spark, sf_dir, "ts", "event_type").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return counts.withColumn("at", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * 86_400)


def _anomalies(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    found = lifecycle.yield_anomalies(_daily(spark, sf_dir), "event_type", "at", "n", drop_threshold=threshold)
    return found.select("event_type", "day", "n", F.round("baseline", 4).alias("baseline"), "samples", F.round("drop_fraction", 8).alias("drop_fraction"))


def trailing_median_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, WIN-04, STM-10 at a threshold of 20 %."""
    return _anomalies(spark, sf_dir, 0.2)


def yield_anomaly_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-10 at the default of 70 %."""
    return _anomalies(spark, sf_dir, 0.7)


def anomaly_sql(threshold: float) -> str:
    return f"""
with daily as (select event_type, cast(ts as date) as day, count(*) as n from events group by 1, 2),
based as (
  select event_type, day, n, median(n) over w as baseline, count(n) over w as samples from daily
  window w as (partition by event_type order by day range between interval 14 day preceding and interval 1 day preceding))
select event_type, day, n, round(baseline, 4) as baseline, samples, round(1 - n / baseline, 8) as drop_fraction
from based where samples >= 3 and baseline >= 10 and 1 - n / baseline > {threshold}
"""


def freshness_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-02, AGG-21."""
    e = _events(spark, sf_dir, "ts", "event_type")
    return e.groupBy("event_type", dates.freshness_band(dates.hours_between(F.col("ts"), _now()), F.lit(True)).alias("band")).agg(F.count("*").alias("n"))


FRESHNESS_BANDS = f"""
with aged as (select event_type, (epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 3.6e9 as h from events)
select event_type, case when h < 6 then 'HOT_0_6H' when h < 24 then 'EARLY_6_24H' when h < 96 then 'FRESH_1_3D' when h < 192 then 'OPEN_4_7D' when h < 360 then 'AGING_8_14D' else 'STALE_15D_PLUS' end as band, count(*) as n
from aged group by 1, 2
"""


def bundle_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-03, OBX-02: each day's errors within 5 a run and 18 a day."""
    errors = _events(spark, sf_dir, "event_id", "ts", "event_type", "value").where("event_type = 'error'").withColumn("day", F.to_date("ts"))
    used = _events(spark, sf_dir, "ts", "event_type", "user_id").where("event_type = 'signup'").groupBy(F.to_date("ts").alias("day")).agg((F.countDistinct("user_id") % 19).alias("used"))
    return outbox.bundle(errors, used, [F.desc("value"), F.col("event_id")], ["day"]).select("event_id", "day", *[F.col(c).cast("long").alias(c) for c in ("place", "pending", "capacity")], "message")


BUNDLE_PLAN = """
with used as (select cast(ts as date) as day, count(distinct user_id) % 19 as used from events where event_type = 'signup' group by 1),
ranked as (
  select event_id, cast(ts as date) as day, row_number() over (partition by cast(ts as date) order by value desc, event_id) as place, count(*) over (partition by cast(ts as date)) as pending
  from events where event_type = 'error'),
capped as (select ranked.*, cast(greatest(0, least(5, 18 - coalesce(used, 0))) as bigint) as capacity from ranked left join used using (day))
select event_id, day, place, pending, capacity, case when capacity = 0 then 'DEFERRED' when pending <= capacity or place < capacity then 'SINGLE' else 'BUNDLE' end as message from capped
"""


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-01: decoded, defaulted, grouped."""
    k = F.coalesce(F.from_json("props", "k long")["k"], F.lit(-1).cast("long"))
    return _events(spark, sf_dir, "props", "value").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


JSON_PROPS = "select coalesce(cast(json_extract(props, '$.k') as bigint), -1) as k, count(*) as n, round(avg(value), 6) as mean_value from events group by 1"


def _kept(spark: SparkSession, sf_dir: str, last: bool) -> DataFrame:
    e = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "value")
    pick = F.max_by if last else F.min_by
    return e.groupBy("user_id").agg(pick(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")


def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, by an ordered maximum that combines map-side."""
    return _kept(spark, sf_dir, True)


def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13."""
    return _kept(spark, sf_dir, False)


def keep_sql(direction: str) -> str:
    return f"select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts {direction}, event_id {direction}) = 1"


def miss_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01/02, WIN-07: misses of a purchase over each user's active days."""
    presence = _events(spark, sf_dir, "ts", "user_id", "event_type").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "purchase").alias("seen"))
    return lifecycle.runs_of_misses(presence, "user_id", "day", "seen").select("user_id", "day", "seen", F.col("misses").cast("long").alias("misses"), "state")


MISS_COUNTER = """
with presence as (select user_id, cast(ts as date) as day, bool_or(event_type = 'purchase') as seen from events group by 1, 2),
blocks as (select *, sum(cast(seen as int)) over (partition by user_id order by day) as block from presence),
counted as (select user_id, day, seen, cast(sum(cast(not seen as int)) over (partition by user_id, block order by day) as bigint) as misses from blocks)
select *, case when misses >= 3 then 'CLOSED' when misses >= 2 then 'POSSIBLY_CLOSED' else 'ACTIVE' end as state from counted
"""

#: Allowed next events, as a small dimension.
FLOW = {"view": ("view", "click", "error"), "click": ("view", "click", "signup", "purchase"), "signup": ("purchase", "view"), "purchase": ("view", "purchase"), "error": ("view", "click", "error")}


def transition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps between a user's events against the allowed pairs; a user of any number of events is many tasks."""
    ranked = numbered(spark, _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type"), [F.col("ts").asc(), F.col("event_id").asc()], ["user_id"])
    before = ranked.select(F.col("user_id").alias("of"), (F.col("rank") + 1).alias("next"), F.col("event_type").alias("from_stage"))
    after = ranked.select("user_id", "rank", F.col("event_type").alias("to_stage"))
    steps = after.join(before, after["user_id"].eqNullSafe(before["of"]) & (after["rank"] == before["next"])).groupBy("from_stage", "to_stage").agg(F.count("*").alias("n"))
    pairs = spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("from_stage"), F.lit(b).alias("to_stage")) for a, bs in FLOW.items() for b in bs])).alias("p")).select("p.*", F.lit(True).alias("allowed"))
    return steps.join(F.broadcast(pairs), ["from_stage", "to_stage"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


TRANSITION_CHECK = f"""
with steps as (select lag(event_type) over (partition by user_id order by ts, event_id) as from_stage, event_type as to_stage from events),
pairs(from_stage, to_stage) as (values {", ".join(f"('{a}', '{b}')" for a, bs in FLOW.items() for b in bs)})
select s.from_stage, s.to_stage, count(*) as n, bool_or(p.to_stage is not null) as allowed
from steps s left join pairs p on s.from_stage = p.from_stage and s.to_stage = p.to_stage where s.from_stage is not null group by 1, 2
"""


def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18, SET-03/04/05: users of a type now or before, each counted once."""
    e = _events(spark, sf_dir, "ts", "user_id", "event_type")
    late = e.where(F.col("ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))
    early = e.where(F.col("ts") < F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    pair = lambda d: d.select("event_type", "user_id")
    return pair(late).unionByName(pair(early)).distinct().groupBy("event_type").agg(F.count("*").alias("users"))


DISTINCT_UNION = """
select event_type, count(*) as users from (
  select event_type, user_id from events where ts >= timestamp '2024-01-29' union select event_type, user_id from events where ts < timestamp '2024-01-03') group by 1
"""


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-07, SET-01: users active late who had no purchase."""
    e = _events(spark, sf_dir, "ts", "user_id", "event_type")
    late = e.where(F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).select("user_id").distinct()
    bought = e.where((F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")) & (F.col("event_type") == "purchase")).select("user_id")
    return late.join(bought, "user_id", "left_anti")


SET_DIFFERENCE = "select user_id from events where ts >= timestamp '2024-01-30' except select user_id from events where ts >= timestamp '2024-01-20' and event_type = 'purchase'"

ENUM = ["view", "click", "signup", "purchase", "refund", "error", "chargeback"]


def enum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16, AGG-01/02/03: listed values, zero-filled."""
    return reports.enum_counts(_events(spark, sf_dir, "event_type"), "event_type", ENUM)


ENUM_COUNTS = f"select label, coalesce(n, 0) as n from (values {', '.join(f'({v!r})' for v in ENUM)}) v(label) left join (select event_type, count(*) as n from events group by 1) e on label = event_type"


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-07: health of users as sources: errors since the last purchase, hours since it."""
    e = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("ok"))
    failed = e.join(last, "user_id").where((F.col("event_type") == "error") & (F.col("ok").isNull() | (F.col("ts") > F.col("ok")))).groupBy("user_id").agg(F.count("*").alias("failures"))
    none = F.lit(None).cast("timestamp_ntz")
    state = planner.health(F.col("user_id") % 11 != 0, F.when(F.col("user_id") % 13 == 0, "AUTH_REQUIRED").otherwise("UNKNOWN"), F.col("ok"), F.coalesce("failures", F.lit(0)), F.lit(24), none, _now(), F.lit(False))
    return last.join(failed, "user_id", "left").select("user_id", F.coalesce("failures", F.lit(0).cast("long")).alias("failures"), state.alias("health"))


SOURCE_HEALTH = f"""
with last as (select user_id, max(ts) filter (where event_type = 'purchase') as ok from events group by 1),
failed as (select user_id, count(*) as failures from events join last using (user_id) where event_type = 'error' and (ok is null or ts > ok) group by 1),
joined as (select user_id, coalesce(failures, 0) as failures, ok, coalesce((epoch_us(timestamp '{NOW}') - epoch_us(ok)) / 3.6e9, 0) as age from last left join failed using (user_id))
select user_id, failures, case when user_id % 11 = 0 then 'PAUSED' when user_id % 13 = 0 then 'AUTH_REQUIRED' when failures >= 3 or age > 96 then 'DOWN' when age > 48 then 'STALE' when failures > 0 then 'DEGRADED' when ok is not null then 'HEALTHY' else 'UNKNOWN' end as health
from joined
"""


def failure_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-14: users' days without a purchase as failures; notices at the third and at recovery."""
    days = _events(spark, sf_dir, "ts", "user_id", "event_type").groupBy("user_id", F.to_date("ts").alias("day")).agg((~F.bool_or(F.col("event_type") == "purchase")).alias("failed"))
    found = digest.failure_episodes(days, "user_id", "day", "failed")
    return found.where("notice is not null").select("user_id", "day", F.col("failures").cast("long").alias("failures"), "notice")


FAILURE_EPISODES = """
with days as (select user_id, cast(ts as date) as day, not bool_or(event_type = 'purchase') as failed from events group by 1, 2),
blocks as (select *, sum(cast(not failed as int)) over (partition by user_id order by day) as block from days),
counted as (select user_id, day, failed, cast(sum(cast(failed as int)) over (partition by user_id, block order by day) as bigint) as failures from blocks),
told as (select *, coalesce(lag(failures) over (partition by user_id order by day), 0) as before from counted)
select user_id, day, failures, case when failures = 3 then 'FAILURE' else 'RECOVERY' end as notice from told where failures = 3 or (not failed and before >= 3)
"""


def title_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-03/09: events whose payload is in scope, before anything else is read."""
    e = _events(spark, sf_dir, "event_id", "event_type", "props")
    return e.where(digest.title_in_scope(F.col("event_type"), ("PURCH", "sign"))).select("event_id", "event_type")


TITLE_SCOPE = "select event_id, event_type from events where contains(lower(event_type), 'purch') or contains(lower(event_type), 'sign')"


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05 as fixed windows of six hours."""
    e = _events(spark, sf_dir, "ts", "event_type", "value").withColumn("bucket", F.floor(_epoch(F.col("ts")) / 21_600).cast("long"))
    return e.groupBy("bucket", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


TUMBLING_WINDOWS = "select cast(epoch_us(ts) // 21600000000 as bigint) as bucket, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"

QUERIES = {f.__name__: f for f in (funnel_cohort, funnel_totals, median_time_to_apply, calendar_windows, trailing_median_anomaly, yield_anomaly_default, freshness_bands, bundle_plan, json_props, keep_last, keep_first, miss_counter, transition_check, distinct_union, set_difference, enum_counts, source_health, failure_episodes, title_scope, tumbling_windows)}
SQL = {
    "funnel_cohort": FUNNEL_COHORT, "funnel_totals": FUNNEL_TOTALS, "median_time_to_apply": MEDIAN_TIME_TO_APPLY, "calendar_windows": CALENDAR_WINDOWS, "trailing_median_anomaly": anomaly_sql(0.2), "yield_anomaly_default": anomaly_sql(0.7),
    "freshness_bands": FRESHNESS_BANDS, "bundle_plan": BUNDLE_PLAN, "json_props": JSON_PROPS, "keep_last": keep_sql("desc"), "keep_first": keep_sql("asc"), "miss_counter": MISS_COUNTER, "transition_check": TRANSITION_CHECK,
    "distinct_union": DISTINCT_UNION, "set_difference": SET_DIFFERENCE, "enum_counts": ENUM_COUNTS, "source_health": SOURCE_HEALTH, "failure_episodes": FAILURE_EPISODES, "title_scope": TITLE_SCOPE, "tumbling_windows": TUMBLING_WINDOWS,
}
