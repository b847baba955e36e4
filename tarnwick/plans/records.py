"""Queries over record snapshots: the authored observations, and documents as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions.text import normalized_text
from tarnwick.operators import normalize, resolve, score
from tarnwick.plans import observations
from tarnwick.tables import read_table


def replay(spark: SparkSession) -> DataFrame:
    """Raw observations to scored canonical records."""
    now = F.lit(observations.NOW).cast("timestamp")
    silver, _ = normalize.split_quarantine(normalize.normalize_jobs(observations.raw(spark), now))
    numbered = silver.join(observations.order(spark), ["source_id", "title", "company", "official_link_state"])
    records = resolve.resolve(spark, numbered)
    return score.score_jobs(records, observations.PROFILE, now)


def golden_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OPS-06: twelve observations give nine records; how many of each priority."""
    return replay(spark).groupBy("action_priority").agg(F.count("*").alias("n"), F.sum("members").cast("long").alias("members"))


GOLDEN_REPLAY = "select * from (values ('P0', 2::bigint, 4::bigint), ('P1', 2, 3), ('P2', 3, 3), ('P3', 1, 1), ('EXCLUDED', 1, 1)) v(action_priority, n, members)"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the source is the employer, the first eight words are the title, some have an id of their board made of their first letters."""
    d = read_table(spark, sf_dir, "documents")
    empty, none, size = F.lit(""), F.lit(None), F.coalesce("n_chars", F.lit(0))
    title = normalized_text(F.regexp_extract(F.coalesce("text", empty), r"^\s*((?:\S+\s+){0,7}\S+)", 1))
    board_id = F.when(size % 5 == 0, F.sha2(F.substring(F.coalesce("text", empty), 1, 30), 256)).otherwise("")
    identity = F.struct(F.lit("docs").alias("provider"), F.coalesce("source", empty).alias("tenant"), board_id.alias("provider_job_id"), empty.alias("canonical_url"), empty.alias("requisition_id"), empty.alias("requisition_namespace"))
    entry = F.struct(F.concat_ws("-", "source", "lang").alias("source_id"), F.concat(F.lit("https://docs.example.org/"), size.cast("string")).alias("url"), F.col("doc_id").cast("string").alias("note"))
    seen = F.timestamp_micros(F.unix_micros(F.lit(observations.NOW).cast("timestamp")) + F.col("doc_id") * 1_000_000)
    return d.select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("job_uid"), F.coalesce("source", empty).alias("normalized_company"), title.alias("title"), title.alias("normalized_title"),
        F.coalesce("lang", empty).alias("location"), F.lit("ONSITE").alias("work_mode"), F.col("text").alias("description"), F.sha2("text", 256).alias("description_hash"), empty.alias("experience_text"), none.cast("timestamp").alias("deadline"),
        empty.alias("apply_url"), empty.alias("canonical_url"), F.lit("VERIFIED_OFFICIAL").alias("official_link_state"), F.array(identity).alias("identities"), F.array(entry).alias("provenance"), none.cast("timestamp").alias("posted_at_source"), F.lit("MISSING").alias("posted_at_confidence"),
        none.cast("double").alias("age_hours_min"), none.cast("double").alias("age_hours_max"), seen.alias("first_seen_at"), seen.alias("last_seen_at"), F.lit(True).alias("baseline"), empty.alias("quarantine_reason"), F.lit("ACTIVE").alias("active_state"),
        F.lit(1).alias("missing_snapshots"),
    ).where("seq is not null")


def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-04, DDP-01 to DDP-06: what became of each document as a posting, an audit row a decision."""
    audit = resolve.resolve_audited(spark, postings(spark, sf_dir))[1]
    return audit.select("seq", "job_uid", "event", "reason", F.array_join(F.array_sort(F.map_keys("diff")), ",").alias("changed_fields"), "new_identities")


def merge_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDP-07, SET-06: the records after all merges, with their united identities and provenance and what a merge resets."""
    found = resolve.resolve(spark, postings(spark, sf_dir))
    told = lambda name, *fields: F.array_join(F.transform(name, lambda x: F.concat_ws(":", *[x[f] for f in fields])), ";")
    seconds = lambda c: F.unix_seconds(F.col(c)) - F.unix_seconds(F.lit(observations.NOW).cast("timestamp"))
    return found.select(
        "seq", "job_uid", "title", F.col("members").cast("long").alias("members"), F.col("changes").cast("long").alias("changes"), "active_state", "quarantine_reason", F.col("missing_snapshots").cast("long").alias("missing_snapshots"),
        told("identities", "tenant", "provider_job_id").alias("identities"), told("provenance", "source_id", "url", "note").alias("provenance"), seconds("first_seen_at").alias("first_seen"), seconds("last_seen_at").alias("last_seen"),
    )


# Longest common subsequences by dynamic programming over lists; the fold by recursion over the rows in order.
_FOLD = """
with recursive doc as materialized (
  select doc_id as seq, coalesce(source, '') as company, coalesce(source, '') as tenant, coalesce(lang, '') as place, text, sha256(text) as hash,
    coalesce(n_chars, 0) as size, regexp_extract(coalesce(text, ''), '^\\s*((?:\\S+\\s+){0,7}\\S+)', 1) as head, string_split(trim(regexp_replace(lower(replace(replace(coalesce(text, ''), 'ß', 'ss'), 'ẞ', 'ss')), '[^a-z0-9]+', ' ', 'g')), ' ') as words,
    concat_ws('-', source, lang) as source_id from documents where doc_id is not null),
posting as materialized (
  select seq, row_number() over (order by seq) as n, company, tenant, place, text, hash, size, source_id, trim(regexp_replace(lower(replace(replace(head, 'ß', 'ss'), 'ẞ', 'ss')), '[^a-z0-9]+', ' ', 'g')) as title,
    case when size % 5 = 0 then sha256(substr(coalesce(text, ''), 1, 30)) else '' end as board_id, list_distinct(list_filter(words, lambda w: w <> '')) as body from doc),
full_row as (select * from posting where company <> '' and place <> '' and coalesce(text, '') <> '' and title <> ''),
word as (select seq, company, place, len(body) as size, unnest(body) as w from full_row),
rare as (select company, place, w, count(*) as n from word group by all),
ordered as (select word.*, row_number() over (partition by seq order by n, w) as k from word join rare using (company, place, w)),
met as (
  select distinct a.seq as a, b.seq as b from ordered a join ordered b using (company, place, w)
  where a.seq < b.seq and a.k <= a.size - ceil(a.size * 0.8 - 1e-9) + 1 and b.k <= b.size - ceil(b.size * 0.8 - 1e-9) + 1 and least(a.size, b.size) >= 0.8 * greatest(a.size, b.size)),
alike as materialized (
  select x.seq as a, y.seq as b, string_split(x.title, '') as s, string_split(y.title, '') as t, 100.0 * len(list_intersect(x.body, y.body)) / (len(x.body) + len(y.body) - len(list_intersect(x.body, y.body))) as body
  from met join full_row x on x.seq = a join full_row y on y.seq = b where len(list_intersect(x.body, y.body)) >= 0.79 * greatest(len(x.body), len(y.body))),
titled as (
  select a, b, body, case when s = t then 100.0 else 200.0 * list_reduce(
      list_transform(s, lambda c: [unicode(c)]),
      lambda row, c: list_reduce(list_transform(range(1, len(t) + 1), lambda k: [k]), lambda acc, k: list_append(acc, case when unicode(t[k[1]]) = c[1] then row[k[1]] + 1 else greatest(acc[k[1]], row[k[1] + 1]) end), [cast(0 as bigint)]),
      list_transform(range(0, len(t) + 1), lambda k: cast(0 as bigint)))[len(t) + 1] / (len(s) + len(t)) end as score from alike),
near as materialized (
  select p.n, list(q.n) filter (where score >= 94 and titled.body >= 92) as sure, list(q.n) filter (where score >= 88 and titled.body >= 80 and not (score >= 94 and titled.body >= 92)) as gray
  from titled join posting p on p.seq = b join posting q on q.seq = a group by p.n),
line as materialized (select posting.n, tenant, board_id, coalesce(sure, []) as sure, coalesce(gray, []) as gray from posting left join near using (n)),
step as (
  select cast(0 as bigint) as n, cast([] as struct(founder bigint, content bigint, tenant varchar, board_id varchar)[]) as held, cast(null as bigint) as rec, cast(null as varchar) as why, cast(null as bigint) as before
  union all
  select m.n, case when m.hit is null then list_append(m.held, {'founder': m.n, 'content': m.n, 'tenant': m.tenant, 'board_id': m.board_id})
      else list_transform(m.held, lambda r: case when r.founder = m.hit.founder then {'founder': r.founder, 'content': m.n, 'tenant': r.tenant, 'board_id': case when r.board_id = '' then m.board_id else r.board_id end} else r end) end,
    coalesce(m.hit.founder, m.n),
    case when m.hit is not null then case when m.board_id <> '' and m.hit.board_id = m.board_id then 'EXACT_PROVIDER_ID' else 'FUZZY' end
      when len(list_filter(m.held, lambda r: not (r.board_id <> '' and m.board_id <> '' and r.board_id <> m.board_id) and list_contains(m.gray, r.content))) > 0 then 'GRAY_ZONE' else 'DISTINCT_IDENTITY' end,
    m.hit.content
  from (
    select line.*, step.held, list_filter(step.held, lambda r: (r.board_id <> '' and r.tenant = line.tenant and r.board_id = line.board_id)
      or (not (r.board_id <> '' and line.board_id <> '' and r.board_id <> line.board_id) and list_contains(line.sure, r.content)))[1] as hit
    from step join line on line.n = step.n + 1) m),
decision as materialized (select n, rec, why, before from step where n > 0),
audit as materialized (
  select p.n, p.seq, f.seq as rec, 'doc_' || f.seq as job_uid, d.why, before is null as new,
    case when d.why = 'FUZZY' then case when b.hash = p.hash and b.title = p.title then 'EXACT_FINGERPRINT' else 'FUZZY_HIGH_CONFIDENCE' end else d.why end as reason,
    case when before is null then '' else concat_ws(',', case when b.hash is distinct from p.hash then 'description_hash' end, case when b.place <> p.place then 'location' end, case when b.title <> p.title then 'title' end) end as changed_fields
  from decision d join posting p on p.n = d.n join posting f on f.n = d.rec left join posting b on b.n = d.before),
member as materialized (select audit.rec, posting.* from audit join posting using (seq))
"""
_AUDIT = """, kind as (select rec, tenant, board_id, min(seq) as seq from member group by all)
select audit.seq, job_uid, case when new then 'NEW' when changed_fields <> '' then 'CHANGED' else 'MERGED' end as event, reason, changed_fields, cast(count(kind.seq) as bigint) as new_identities
from audit left join kind using (seq) group by all"""
_LINEAGE = """, kind as (select rec, tenant, board_id, min(seq) as seq from member group by all),
told as (select rec, string_agg(tenant || ':' || board_id, ';' order by seq) as identities from kind group by rec),
entry as (select rec, source_id, size as n_words, min(seq) as seq from member group by all),
trail as (select rec, string_agg(source_id || ':https://docs.example.org/' || n_words || ':' || seq, ';' order by seq) as provenance from entry group by rec),
total as (
  select audit.rec, count(*) as members, count(*) filter (where changed_fields <> '') as changes, max(seq) as last, min(seq) as first, arg_max(changed_fields <> '', seq) as moved, bool_or(why = 'GRAY_ZONE' and seq = rec) as gray from audit group by audit.rec)
select rec as seq, 'doc_' || rec as job_uid, p.title, cast(members as bigint) as members, cast(changes as bigint) as changes, case when members > 1 and moved then 'CHANGED' else 'ACTIVE' end as active_state,
  case when gray and members = 1 then 'UNRESOLVED_DUPLICATE_GRAY_ZONE' else '' end as quarantine_reason, cast(case when members > 1 then 0 else 1 end as bigint) as missing_snapshots, identities, provenance, cast(first as bigint) as first_seen, cast(last as bigint) as last_seen
from total join told using (rec) join trail using (rec) join posting p on p.seq = total.last"""

QUERIES = {f.__name__: f for f in (golden_replay, entity_resolution, merge_lineage)}
SQL = {"golden_replay": GOLDEN_REPLAY, "entity_resolution": _FOLD + _AUDIT, "merge_lineage": _FOLD + _LINEAGE}
