"""Queries over the star schema: joins, ranking, scores, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.functions.hashing import record_uid, uid
from tarnwick.operators import lifecycle, planner, score, upsert
from tarnwick.tables import read_table

NOW = "2001-08-02 00:00:00"
SINCE = "2001-01-01 00:00:00"


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-01/07: the right side is one row per key before the join."""
    totals = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(totals, "c_custkey", "left").select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


LEFT_JOIN_DEFAULT = "select c_custkey, c_mktsegment, coalesce(n, 0) as n, coalesce(total, 0.0) as total from customer left join (select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1) on c_custkey = o_custkey"


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= _ntz(SINCE)).select(F.col("o_custkey").alias("c_custkey"))


def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-02/12."""
    return read_table(spark, sf_dir, "customer").join(_recent(spark, sf_dir), "c_custkey", "left_semi").select("c_custkey", "c_name")


def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09/10."""
    return read_table(spark, sf_dir, "customer").join(_recent(spark, sf_dir), "c_custkey", "left_anti").select("c_custkey", "c_name")


def _exists_sql(kind: str) -> str:
    return f"select c_custkey, c_name from customer where {kind} exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '{SINCE}')"


def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01/02/03: three largest orders per customer."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("place", place.cast("long")).where("place <= 3")


TOP_K_PER_GROUP = "select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders qualify place <= 3"


def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-07/08, AGG-15, MTH-01: weighted signals, clamped and rounded."""
    p = read_table(spark, sf_dir, "part")
    signals = {"size": F.col("p_size") / 50, "price": score.clamp((F.col("p_retailprice") - 900) / 1200, 0.0, 1.0), "economy": F.when(F.col("p_type") == "ECONOMY", 1.0).otherwise(0.4)}
    total = score.clamp(score.weighted(signals, {"size": 50.0, "price": 30.0, "economy": 20.0}) - F.when(F.col("p_brand") == "Brand#1", 25.0).otherwise(0.0))
    return p.select("p_partkey", F.round(total, 4).alias("score"))


WEIGHTED_SCORE = """
select p_partkey, round(greatest(0.0, least(100.0, p_size / 50 * 50.0 + greatest(0.0, least(1.0, (p_retailprice - 900) / 1200)) * 30.0 + (case when p_type = 'ECONOMY' then 1.0 else 0.4 end) * 20.0
  - case when p_brand = 'Brand#1' then 25.0 else 0.0 end)), 4) as score from part
"""


def priority_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-09: orders as records; price is fit, discount priority, age in days as hours."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum("l_quantity") / F.count("*") * 2).alias("priority"))
    o = read_table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    age = F.datediff(F.to_date(_ntz(NOW)), F.to_date("o_orderdate")).cast("double")
    fit, priority = F.col("o_totalprice") / 5000, F.coalesce("priority", F.lit(0.0)) * 1.5
    stage = F.when(F.col("o_orderkey") % 17 == 0, "APPLIED").otherwise("NONE")
    exclusion = F.when(F.col("o_orderpriority") == "5-LOW", "LOW").otherwise("")
    step = score.ladder(fit, priority, F.col("o_orderstatus") != "P", age, F.lit(False), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 7 == 0, exclusion, stage)
    return o.select("o_orderkey", step.alias("s")).select("o_orderkey", F.col("s.priority").alias("action_priority"), F.col("s.eligibility").alias("action_eligibility"))


PRIORITY_LADDER = f"""
with lines as (select l_orderkey, sum(l_quantity) / count(*) * 2 as p from lineitem group by 1),
rec as (
  select o_orderkey, o_totalprice / 5000 as fit, coalesce(p, 0.0) * 1.5 as pri, date_diff('day', cast(o_orderdate as date), date '{NOW[:10]}') as age, o_orderstatus <> 'P' as route,
    o_orderkey % 7 = 0 as q, o_orderpriority = '5-LOW' as out, o_orderpriority = '1-URGENT' as chg from orders left join lines on l_orderkey = o_orderkey),
rung as (select *, case when o_orderkey % 17 = 0 then 'PIPELINE' when out then 'EXCLUDED' when fit >= 75 and pri >= 85 and route and age >= 0 and age < 24 and not q then 'P0'
  when fit >= 60 and pri >= 70 and route and ((age >= 0 and age < 192) or chg) and not q then 'P1' when pri >= 50 then 'P2' else 'P3' end as action_priority from rec)
select o_orderkey, action_priority, case action_priority when 'PIPELINE' then 'TRACKING' when 'EXCLUDED' then 'BLOCKED_HARD' when 'P0' then 'READY' when 'P1' then 'READY'
  else case when q then 'QUARANTINED' when not route then 'NEEDS_OFFICIAL_LINK' else 'NEEDS_REVIEW' end end as action_eligibility from rung
"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    none = F.lit(None).cast("double")
    return s.select(
        F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") % 9 != 0).alias("enabled"), F.when(F.col("s_suppkey") % 10 == 1, 9000.0).otherwise(none).alias("backoff_until"),
        F.when(F.col("s_nationkey") == 3, "PAUSED").otherwise("HEALTHY").alias("health_state"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("next_due_at"), (F.col("s_nationkey") % 3).alias("priority_tier"),
        F.when(F.col("s_suppkey") % 8 == 2, "PARTIAL_BUDGET").otherwise("NO_CHANGE").alias("last_outcome"),
    )


def _planned(spark: SparkSession, sf_dir: str, selected: bool) -> DataFrame:
    found = planner.plan(_sources(spark, sf_dir), F.lit(6000.0), 25)
    return found.where(F.col("selected") == selected).select("source_id", F.col("place").cast("long").alias("place"))


def planner_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01, PRD-02: due sources that the budget takes."""
    return _planned(spark, sf_dir, True)


def planner_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01: due sources that it leaves."""
    return _planned(spark, sf_dir, False)


def planner_sql(sign: str) -> str:
    return f"""
with s as (
  select s_suppkey as source_id, case when s_acctbal > 0 then s_acctbal end as due, s_nationkey % 3 as tier, s_suppkey % 8 = 2 as partial from supplier
  where s_suppkey % 9 <> 0 and s_suppkey % 10 <> 1 and s_nationkey <> 3 and (s_acctbal <= 6000 or s_acctbal is null))
select source_id, row_number() over (order by not partial, due asc nulls first, tier, source_id) as place from s qualify place {sign} 25
"""


def digest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-01/03."""
    o = read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    by_id = record_uid("job_", F.lit("orders"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 != 0, key), F.concat(F.lit("https://x/"), key))
    return o.select("o_orderkey", uid(F.col("o_orderkey"), F.col("o_custkey"), F.nullif(F.col("o_orderstatus"), F.lit("P"))).alias("uid"), by_id.alias("record_uid"))


DIGEST_IDS = """
select o_orderkey, sha256(o_orderkey || chr(31) || o_custkey || chr(31) || case when o_orderstatus = 'P' then '' else o_orderstatus end) as uid,
  'job_' || substr(sha256(case when o_orderkey % 3 <> 0 then 'orders|' || o_orderstatus || '|' || o_orderkey else 'https://x/' || o_orderkey end), 1, 24) as record_uid from orders
"""

SPEC = upsert.TableSpec("orders", "o_orderkey", ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), user_columns=("o_orderpriority",))


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read_table(spark, sf_dir, "orders").select(*SPEC.columns)
    touched = F.col("o_orderkey") % 11 == 0
    new = o.where(F.col("o_orderkey") % 5 != 1).withColumns({"o_orderstatus": F.when(touched, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.lit("0-MACHINE")})
    return o.where(F.col("o_orderkey") % 5 != 0), new


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01/03, DDP-10: full outer merge that spares user columns."""
    return upsert.upsert(*_old_new(spark, sf_dir), SPEC)


_OLD_NEW = """
old as (select o_orderkey as k, o_orderstatus as s, o_totalprice as t, o_orderpriority as p from orders where o_orderkey % 5 <> 0),
new as (select o_orderkey as k, case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end as s, case when o_orderkey % 13 = 0 then o_totalprice + 1 else o_totalprice end as t, '0-MACHINE' as p from orders where o_orderkey % 5 <> 1)
"""

UPSERT_SNAPSHOT = f"""
with {_OLD_NEW}
select coalesce(n.k, o.k) as o_orderkey, coalesce(n.s, o.s) as o_orderstatus, coalesce(n.t, o.t) as o_totalprice, coalesce(o.p, n.p) as o_orderpriority,
  case when o.k is null then 'INSERTED' when n.k is null then 'KEPT' when o.s <> n.s or o.t <> n.t then 'CHANGED' else 'SAME' end as change
from old o full join new n on o.k = n.k
"""


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDP-08/09, WIN-06: what changed, and the first rule that names it."""
    old, new = _old_new(spark, sf_dir)
    diff = lifecycle.material_changes(old, new, "o_orderkey", ("o_orderstatus", "o_totalprice"))
    kind = lifecycle.change_event([(F.map_contains_key("diff", "o_orderstatus"), "STATUS_CHANGED"), (F.map_contains_key("diff", "o_totalprice"), "PRICE_CHANGED")])
    return diff.select("o_orderkey", kind.alias("event"), F.size("diff").cast("long").alias("fields"), F.col("diff")["o_orderstatus"]["before"].alias("status_before"))


CHANGE_EVENTS = f"""
with {_OLD_NEW}
select o.k as o_orderkey, case when o.s <> n.s then 'STATUS_CHANGED' else 'PRICE_CHANGED' end as event, cast(cast(o.s <> n.s as int) + cast(o.t <> n.t as int) as bigint) as fields, case when o.s <> n.s then o.s end as status_before
from old o join new n on o.k = n.k where o.s <> n.s or o.t <> n.t
"""


def append_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02: append of new keys only."""
    old, new = _old_new(spark, sf_dir)
    return upsert.append_new(old, new, "o_orderkey").select("o_orderkey", "o_orderstatus")


APPEND_GUARD = f"with {_OLD_NEW} select k as o_orderkey, s as o_orderstatus from new where k not in (select k from old)"


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: keys that would fail finalization."""
    return upsert.duplicate_keys(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "k")


DUPLICATE_KEYS = "select l_orderkey * 10 + l_linenumber as k, count(*) as copies from lineitem group by 1 having count(*) > 1"


def experience_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-02 over part sizes as requirements."""
    years = F.when(F.col("p_size") % 7 != 0, (F.col("p_size") % 6) / 1.5)
    return read_table(spark, sf_dir, "part").groupBy(score.experience_fit(years, F.lit(1.2), F.lit(2.3)).alias("experience")).agg(F.count("*").alias("n"))


EXPERIENCE_CLASSES = """
with y as (select case when p_size % 7 <> 0 then (p_size % 6) / 1.5 end as r from part)
select case when r is null then 'AMBIGUOUS' when r >= 4 then 'OUT_OF_SCOPE' when r >= 3 then 'STRETCH' when r = 0 then 'IN_RANGE' when 1.2 >= r then 'MEETS' when 2.3 >= r then 'AMBIGUOUS' else 'NEAR_MATCH_IN_SCOPE' end as experience, count(*) as n from y group by 1
"""


def worst_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23 over 400 years."""
    return planner.worst_month(spark)


WORST_MONTH = """
with d as (select unnest(generate_series(date '2000-01-01', date '2399-12-31', interval 1 day)) as d),
m as (select year(d) as y, month(d) as m, count(*) as n, count(*) filter (where isodow(d) < 6) as w, count(*) filter (where isodow(d) = 7) as s from d group by 1, 2)
select max((w * 6 + (n - w) * 3) * 4 + n * 16 + s * 8) as scheduled_minutes, max((w * 6 + (n - w) * 3) * 4 + n * 16 + s * 8) + 200 as planned_minutes from m
"""


def grouping_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08/22 as one pass of grouping sets over orders and their nation."""
    o, c, n = (read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.groupingSets([["n_name"], ["o_orderstatus"], []], "n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.try_divide(F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double"), F.count("*")), 8).alias("urgent_rate"))


GROUPING_ROLLUP = """
select n_name, o_orderstatus, count(*) as n, round(count(*) filter (where o_orderpriority = '1-URGENT') / count(*), 8) as urgent_rate
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by grouping sets ((n_name), (o_orderstatus), ())
"""

QUERIES = {f.__name__: f for f in (left_join_default, semi_join, anti_join, top_k_per_group, weighted_score, priority_ladder, planner_select, planner_deferred, digest_ids, upsert_snapshot, change_events, append_guard, duplicate_keys, experience_classes, worst_month, grouping_rollup)}
SQL = {
    "left_join_default": LEFT_JOIN_DEFAULT, "semi_join": _exists_sql(""), "anti_join": _exists_sql("not"), "top_k_per_group": TOP_K_PER_GROUP, "weighted_score": WEIGHTED_SCORE, "priority_ladder": PRIORITY_LADDER,
    "planner_select": planner_sql("<="), "planner_deferred": planner_sql(">"), "digest_ids": DIGEST_IDS, "upsert_snapshot": UPSERT_SNAPSHOT, "change_events": CHANGE_EVENTS, "append_guard": APPEND_GUARD, "duplicate_keys": DUPLICATE_KEYS,
    "experience_classes": EXPERIENCE_CLASSES, "worst_month": WORST_MONTH, "grouping_rollup": GROUPING_ROLLUP,
}
