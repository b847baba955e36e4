"""Queries of drafts, claims, public contacts, deliveries, digests, overrides and sitemaps over the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators import contacts, outbox, outreach, overrides
from tarnwick.plans.ledgers import _SQL_NOW, _now, _pick, _sql_pick
from tarnwick.sources import markup
from tarnwick.tables import read_table

_CLAIMS = ("Built a service that answers a thousand calls a second on two small machines", "Wrote the tests of a ledger that two teams use each day.", "Moved a nightly job to a stream and cut its delay to a minute", "10x faster than all others")


def draft_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTC-04, PRD-11: drafts of suppliers as records to customers as contacts, whole texts by digest."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    # Ten records meet all contacts, so only keys and names are joined; the rest is made where a pair is.
    met = read_table(spark, sf_dir, "customer").select(k, "c_name", (k % 10 + 1).alias("s_suppkey")).join(read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    pairs = met.select(
        F.concat(F.lit("contact_"), k.cast("string")).alias("contact_uid"), F.when(k % 9 != 0, F.col("c_name")).alias("name"), F.concat(F.lit("Firm "), (k % 10 + 1).cast("string"), F.when(k % 4 == 0, " Other").otherwise(" Ltd")).alias("contact_company"),
        F.when(k % 5 == 0, "PUBLIC_PAGE").otherwise("USER_CSV").alias("contact_origin"), F.when(k % 7 == 0, "UNKNOWN").otherwise("FORMER_COLLEAGUE").alias("relationship_basis"), F.lit("USER_SUPPLIED_CURRENT").alias("current_company_confidence"), F.timestamp_add("DAY", (-(k % 200)).cast("int"), _now()).alias("evidence_fetched_at"),
        F.lit("https://example.org/in").alias("linkedin_url"), F.when(k % 3 != 0, "a@example.org").otherwise("").alias("work_email"), F.lit("+911234567890").alias("phone"), (k % 2 == 0).alias("whatsapp_allowed"), F.array(F.lit("linkedin_url"), F.lit("work_email"), F.when(k % 8 != 0, "phone").otherwise("none")).alias("stated"),
        (k % 11 == 0).alias("do_not_contact"), F.lit(True).alias("outreach_allowed"), F.lit("NONE").alias("reply_state"), F.lit(None).cast("timestamp_ntz").alias("retention_expires_at"), F.when(k % 10 == 0, "EXPLICIT_RECRUITING_CHANNEL: page").otherwise("").alias("contactability_basis"), F.when(k % 6 == 0, F.timestamp_add("DAY", (-(k % 60)).cast("int"), _now())).alias("last_contacted_at"), F.lit(0).alias("follow_up_count"),
        s.cast("string").alias("job_uid"), F.concat(F.lit("Engineer "), F.col("s_name")).alias("title"), F.concat(F.lit("Firm "), s.cast("string")).alias("company"), F.concat(F.lit("firm "), s.cast("string")).alias("normalized_company"), F.concat(F.lit("https://jobs.example.org/"), s.cast("string")).alias("apply_url"),
        F.array(F.struct(F.when(s % 2 == 0, F.concat(F.lit("id-"), s.cast("string"))).otherwise("").alias("provider_job_id"))).alias("identities"), F.when(s % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Java"), F.lit("SQL"))).alias("required_skills"), F.lit("FULL_STACK").alias("role_family"), (s % 4).alias("sequence"), _pick(("P0", "P1", "P2", "P1"), s).alias("action_priority"),
        F.when(s % 13 == 0, "NEEDS_REVIEW").otherwise("READY").alias("action_eligibility"), F.array(_pick(_CLAIMS, s), F.lit(_CLAIMS[1])).alias("claims"), F.array(F.lit("e1"), F.lit("e2")).alias("evidence_ids"),
    )
    found = outreach.generate_drafts(pairs, spark.createDataFrame([], "draft_id string"), _now(), "A. Candidate")
    return found.select("draft_id", "job_uid", "contact_uid", "channel", "purpose", "subject", F.sha2("text", 256).alias("text_digest"), F.array_join("evidence_ids", ",").alias("evidence"), F.col("words").cast("long").alias("words"), F.col("chars").cast("long").alias("chars"), "error")


def _sql_text(template: str) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"v_{p}" if n % 2 else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for n, p in enumerate(parts) if n % 2 or p)


def _sql_words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def _sql_error(text: str, channel: str, subject: str) -> str:
    """PRD-11 in SQL."""
    unsafe = " or ".join(f"contains(lower({text}), '{x}')" for x in contacts.UNSAFE_CLAIMS)
    outside = " ".join(f"when {channel} = '{k}' and ({_sql_words(text)} < {v[0]} or {_sql_words(text)} > {v[1]}) then 'WORDS_OUTSIDE_LIMIT'" for k, v in contacts.WORD_LIMITS.items())
    known = ", ".join(f"'{k}'" for k in (*contacts.WORD_LIMITS, "LINKEDIN_CONNECTION"))
    return f"""case when regexp_matches({text} || {subject}, '(?i)\\{{\\{{|\\}}\\}}|\\{{(?:company|name|role)\\}}|\\[(?:name|company|role|link)\\]') then 'UNRESOLVED_PLACEHOLDER' when {unsafe} then 'UNSAFE_CLAIM'
      when {channel} = 'LINKEDIN_CONNECTION' and length({text}) > {contacts.NOTE_CHARS} then 'NOTE_TOO_LONG' when {channel} not in ({known}) then 'UNKNOWN_CHANNEL' {outside} when length({subject}) > {contacts.SUBJECT_CHARS} then 'SUBJECT_TOO_LONG' end"""


DRAFT_TEXTS = f"""
with pair as (
  select cast(s_suppkey as varchar) as job_uid, 'contact_' || c_custkey as contact_uid, s_suppkey % 4 as sequence, 'Engineer ' || s_name as v_title, 'Firm ' || s_suppkey as v_company, case when s_suppkey % 2 = 0 then 'id-' || s_suppkey else cast(s_suppkey as varchar) end as v_job_id,
    case when s_suppkey % 3 = 0 then 'full stack' else 'Java, SQL' end as v_focus, 'https://jobs.example.org/' || s_suppkey as v_url, 'A. Candidate' as v_candidate, rtrim({_sql_pick(_CLAIMS, "s_suppkey")}, '.') || '.' as v_claim, rtrim({_sql_pick(_CLAIMS, "s_suppkey")}, '.') || '. ' || '{_CLAIMS[1]}' as v_claims,
    case when c_custkey % 9 <> 0 then 'Hello ' || c_name || ',' else 'Hello,' end as v_greeting, c_custkey % 5 <> 0 and c_custkey % 7 <> 0 and c_custkey % 4 <> 0 and c_custkey % 200 <= 180 as warm,
    c_custkey % 11 <> 0 and (c_custkey % 5 <> 0 or c_custkey % 10 = 0) and not (c_custkey % 6 = 0 and c_custkey % 60 < 30) as open_to, c_custkey as k
  from customer join supplier on s_suppkey = c_custkey % 10 + 1 where {_sql_pick(("P0", "P1", "P2", "P1"), "s_suppkey")} <> 'P2' and s_suppkey % 13 <> 0),
asked as (select *, case when warm then '{outreach.ASKS[True][0]}' else '{outreach.ASKS[False][0]}' end as v_ask, case when warm then '{outreach.ASKS[True][1]}' else '{outreach.ASKS[False][1]}' end as v_short_ask, case when warm then 'REFERRAL' else 'ROLE_INQUIRY' end as why from pair),
draft as (
  select job_uid, '' as contact_uid, 'APPLICATION_NOTE' as channel, 'APPLICATION' as purpose, sequence, v_title, v_job_id, {_sql_text(outreach.TEMPLATES["APPLICATION_NOTE"])} as text from asked
  union select job_uid, contact_uid, 'LINKEDIN_MESSAGE', why, sequence, v_title, v_job_id, {_sql_text(outreach.TEMPLATES["LINKEDIN_MESSAGE"])} from asked where open_to
  union select job_uid, contact_uid, 'LINKEDIN_CONNECTION', 'CONNECT', sequence, v_title, v_job_id, {_sql_text(outreach.TEMPLATES["LINKEDIN_CONNECTION"])} from asked where open_to and length({_sql_text(outreach.TEMPLATES["LINKEDIN_CONNECTION"])}) <= 250
  union select job_uid, contact_uid, 'EMAIL', why, sequence, v_title, v_job_id, {_sql_text(outreach.TEMPLATES["EMAIL"])} from asked where open_to and k % 3 <> 0
  union select job_uid, contact_uid, 'WHATSAPP', why, sequence, v_title, v_job_id, {_sql_text(outreach.TEMPLATES["WHATSAPP"])} from asked where open_to and k % 8 <> 0 and k % 2 = 0),
named as (select *, case when channel = 'EMAIL' then substr(v_title || ' - ' || v_job_id, 1, 60) else '' end as subject from draft)
select 'draft_' || substr(sha256(job_uid || '|' || contact_uid || '|' || channel || '|' || purpose || '|' || sequence), 1, 24) as draft_id, job_uid, contact_uid, channel, purpose, subject, sha256(text) as text_digest,
  case channel when 'WHATSAPP' then 'e1' when 'LINKEDIN_CONNECTION' then '' else 'e1,e2' end as evidence, cast({_sql_words("text")} as bigint) as words, cast(length(text) as bigint) as chars, {_sql_error("text", "channel", "subject")} as error from named
"""

_WAYS = ("LINKEDIN_MESSAGE", "EMAIL", "WHATSAPP", "APPLICATION_NOTE", "FOLLOW_UP", "LINKEDIN_CONNECTION", "FAX")


def draft_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-11: whole documents as drafts of every channel."""
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    channel = _pick(_WAYS, F.col("doc_id"))
    return d.select("doc_id", channel.alias("channel"), contacts.draft_error(F.col("text"), channel, F.col("source")).alias("error"))


DRAFT_CHECKS = f"select doc_id, {_sql_pick(_WAYS, 'doc_id')} as channel, {_sql_error('text', _sql_pick(_WAYS, 'doc_id'), 'source')} as error from documents where text is not null"


def approved_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-10: parts as evidence: their names as claims, their brands as what may not be said."""
    k, name = F.col("p_partkey"), F.col("p_name")
    piece = lambda allowed, claims, denied: F.struct(allowed.alias("allowed_in_outreach"), claims.alias("allowed_atomic_claims"), denied.alias("forbidden_extrapolations"))
    long_one = F.array_join(F.array_repeat(F.lit("word"), 33), " ")
    first = piece(k % 3 != 0, F.array(F.lit(" "), long_one, F.concat(F.lit("Stealth "), name), F.concat(F.lit(" "), name, F.lit(" "))), F.when(k % 4 == 0, F.array(F.upper(F.substring("p_name", 1, 4)))))
    second = piece(k % 5 != 0, F.array(F.when(k % 2 == 0, name).otherwise(F.col("p_type"))), F.array(F.col("p_brand")))
    third = piece(F.lit(True), F.array(F.lit("never reached")), F.array().cast("array<string>"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(contacts.approved_claims(F.array(first, second, third)), ";").alias("claims"))


APPROVED_CLAIMS = """
with piece as (
  select p_partkey, case when p_partkey % 3 <> 0 and p_name <> '' and not (p_partkey % 4 = 0 and contains(lower(p_name), lower(substr(p_name, 1, 4)))) then trim(p_name) end as a,
    case when p_partkey % 5 <> 0 then case when p_partkey % 2 = 0 then case when not contains(lower(p_name), lower(p_brand)) then trim(p_name) end else case when not contains(lower(p_type), lower(p_brand)) then trim(p_type) end end end as b from part)
select p_partkey, concat_ws(';', a, case when b is distinct from a then b end) as claims from piece
"""


def public_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTC-02: documents as pages that name an address; which of them may be used."""
    email = F.regexp_extract("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]+", 0)
    pages = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 != 0, "Hiring contact: ").otherwise("Contact: "), "text").alias("evidence"), F.when(F.col("doc_id") % 10 == 0, "else@example.org").otherwise(email).alias("observed_email"), (F.col("doc_id") % 4 != 0).alias("approved"))
    return pages.select("doc_id", F.lower("observed_email").alias("email"), F.coalesce(contacts.public_contact(F.col("doc_id") % 7 != 0), F.lit(False)).alias("usable"))


PUBLIC_CONTACTS = """
with page as (
  select doc_id, case when doc_id % 3 <> 0 then 'Hiring contact: ' else 'Contact: ' end || text as evidence, lower(case when doc_id % 10 = 0 then 'else@example.org' else regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[a-z]+') end) as email from documents where text is not null)
select doc_id, email, doc_id % 4 <> 0 and doc_id % 7 <> 0 and regexp_matches(evidence, '(?i)recruit|talent|hiring|careers') and regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[a-z]{2,}$') and contains(lower(evidence), email) as usable from page
"""


def overrides_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16, SCR-12, SCR-11: purchases as records, errors and views as overrides of their user; errors give no reason."""
    e = read_table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    records = e.where("event_type = 'purchase'").select("event_id", "user_id", "at", "ts")
    changes = e.where("event_type in ('error', 'view')").select("user_id", "at", F.col("value").alias("priority"), (F.col("event_id") % 2 == 0).alias("include"), F.when(F.col("event_type") == "view", "seen by hand").otherwise(" ").alias("reason"))
    found = overrides.manual_as_of(records, changes, "user_id", "at", ["priority", "include"])
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    due = overrides.due_no_later(day("ts"), F.when(F.col("priority") > 50, day(F.timestamp_add("DAY", F.lit(-1), F.col("ts")))).otherwise(""))
    return found.select("event_id", "priority", F.col("include").cast("string").alias("include"), "reason", due.alias("due"))


OVERRIDES_AS_OF = """
with change as (select user_id, ts, max({'priority': value, 'include': event_id % 2 = 0, 'reason': case when event_type = 'view' then 'seen by hand' else ' ' end}) as c from events where event_type in ('error', 'view') group by 1, 2),
met as (select r.event_id, r.ts, case when trim(c.reason) <> '' then c end as c from (select * from events where event_type = 'purchase') r asof left join change on r.user_id = change.user_id and r.ts >= change.ts)
select event_id, c.priority as priority, cast(c.include as varchar) as include, c.reason as reason, strftime(case when c.priority > 50 then ts - interval 1 day else ts end, '%Y-%m-%d') as due from met
"""


def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16: events as rows with a stored model; a filled cell lies over it."""
    n = F.col("event_id")
    rows = read_table(spark, sf_dir, "events").select(n, F.when(n % 7 == 0, "broken").otherwise(F.col("props")).alias("model_json"), F.when(n % 3 == 0, "").when(n % 3 == 1, (n % 50).cast("string")).alias("k"), F.when(n % 5 == 0, "no number").when(n % 5 == 1, "1.5").otherwise(" ").alias("weight"))
    return overrides.typed(rows, "k long, weight double").select("event_id", "k", "weight")


TYPED_CELLS = """
select event_id, case when event_id % 3 = 1 then event_id % 50 when event_id % 7 <> 0 then cast(json_extract(props, '$.k') as bigint) end as k, case when event_id % 5 = 1 then 1.5::double end as weight from events
"""


def delivery_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OBX-04: events as alerts, bundled by user and hour, claimed whole and settled by what came back."""
    n, none = F.col("event_id"), F.lit(None).cast("string")
    e = read_table(spark, sf_dir, "events").withColumn("message_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHH")))
    box = e.select(n.alias("alert_id"), F.when(n % 17 == 0, "SENT").when(n % 19 == 0, "SENDING").otherwise("PENDING").alias("state"), F.when(n % 23 == 0, 1).otherwise(0).alias("automatic_attempts"), F.lit(None).cast("timestamp_ntz").alias("sending_at"), F.lit(None).cast("timestamp_ntz").alias("sent_at"), none.alias("message_id"), none.alias("provider_message_id"), none.alias("error"))
    claimed = outbox.claim_messages(box, e.where("event_type <> 'view'").select("message_id", n.alias("alert_id")), _now())
    kind = (F.col("user_id") + F.hour("ts")) % 4
    answers = e.select("message_id", kind.alias("kind")).distinct()
    kind = F.col("kind")
    answers = answers.where(kind != 3).select("message_id", F.when(kind == 0, "SENT").when(kind == 1, "FAILED").alias("state"), F.concat(F.lit("p-"), "message_id").alias("provider_message_id"), F.when(kind == 1, "mail to a@b.org refused").alias("error"))
    found = outbox.settle(claimed, answers, _now())
    return found.select("alert_id", "state", "message_id", F.col("automatic_attempts").cast("long").alias("attempts"), "provider_message_id", "error", F.col("sent_at").isNotNull().alias("was_sent"))


DELIVERY_STATES = """
with event as (
  select event_id as alert_id, user_id || '-' || strftime(ts, '%Y%m%d%H') as m, (user_id + hour(ts)) % 4 as kind, event_type <> 'view' as planned, case when event_id % 17 = 0 then 'SENT' when event_id % 19 = 0 then 'SENDING' else 'PENDING' end as state, case when event_id % 23 = 0 then 1 else 0 end as tried from events),
whole as (select m from event where planned group by m having bool_and(state = 'PENDING' and tried = 0)),
claimed as (select event.*, planned and whole.m is not null as mine from event left join whole using (m))
select alert_id, case when mine then (['SENT', 'FAILED', 'AMBIGUOUS', 'AMBIGUOUS'])[kind + 1] when state = 'SENDING' then 'AMBIGUOUS' else state end as state, case when mine then m end as message_id, cast(case when mine then 1 else tried end as bigint) as attempts, case when mine and kind < 3 then 'p-' || m end as provider_message_id,
  case when mine then (['', 'mail to [EMAIL] refused', 'TRANSPORT_RESPONSE_LOST', 'INTERRUPTED_AFTER_SEND_CLAIM'])[kind + 1] when state = 'SENDING' then 'INTERRUPTED_AFTER_SEND_CLAIM' end as error, mine and kind = 0 as was_sent from claimed
"""


def digest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OBX-05, SRT-05: each day's digest: errors first, then purchases by value; the first twenty lines."""
    e = read_table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')")
    part = F.when(F.col("event_type") == "error", 1).otherwise(2)
    lines = e.select(F.to_date("ts").cast("string").alias("day"), part.alias("part"), F.when(part == 2, F.col("value")).alias("score"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("uid"), F.concat(F.when(part == 1, "OVERDUE: ").otherwise("P0 "), F.lit("event "), F.col("event_id").cast("string"), F.lit(" of user "), F.col("user_id").cast("string")).alias("line"))
    return outbox.render_digests(lines, "day").select("day", "n_entries", F.sha2("text", 256).alias("digest"))


DIGEST_TEXTS = """
with line as (
  select cast(cast(ts as date) as varchar) as day, case when event_type = 'error' then 1 else 2 end as part, case when event_type = 'purchase' then value end as score, event_id, case when event_type = 'error' then 'OVERDUE: ' else 'P0 ' end || 'event ' || event_id || ' of user ' || user_id as line
  from events where event_type in ('error', 'purchase')),
placed as (select *, row_number() over (partition by day order by part, score desc nulls last, event_id) as place, count(*) over (partition by day) as n from line)
select day, n as n_entries, sha256(string_agg(line, chr(10) || chr(10) order by place) || case when n > 20 then chr(10) || chr(10) || (n - 20) || ' more' else '' end) as digest from placed where place <= 20 group by day, n
"""


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: pages as recorded sitemaps of their hosts; distinct addresses of each, and the maps that are refused."""
    clean = F.regexp_replace("url", "[?#].*$", "")
    host = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    p = read_table(spark, sf_dir, "pages").where("url is not null").select(host.alias("host"), F.floor(F.col("page_id") / 1000).cast("string").alias("block"), F.when(F.col("page_id") % 97 == 0, "https://elsewhere.example.org/x").otherwise(clean).alias("loc"), "page_id")
    maps = p.groupBy("host", "block").agg(F.expr("listagg('<url><loc>' || loc || '</loc></url>', '') within group (order by page_id)").alias("locs"))
    found, errors = markup.parse_sitemaps(maps.select(F.concat_ws("#", "host", "block").alias("source_id"), F.concat("host", F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<urlset>"), "locs", F.lit("</urlset>")).alias("content")))
    return found.groupBy("source_id").agg(F.count("*").alias("n"), F.lit("").alias("error")).unionByName(errors.select("source_id", F.lit(0).cast("long").alias("n"), "error"))


SITEMAP_URLS = """
with page as (select regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as host, page_id // 1000 as block, case when page_id % 97 = 0 then 'https://elsewhere.example.org/x' else regexp_replace(url, '[?#].*$', '') end as loc from pages where url is not null),
map as (select host || '#' || block as source_id, count(distinct loc) as n, bool_or(regexp_extract(loc, '^[a-z]+://([^/?#]+)', 1) <> regexp_extract(host, '^[a-z]+://([^/?#]+)', 1)) as foreign_loc from page group by host, block)
select source_id, case when foreign_loc then 0 else n end as n, case when foreign_loc then 'SITEMAP_CROSS_ORIGIN' else '' end as error from map
"""

QUERIES = {f.__name__: f for f in (draft_texts, draft_checks, approved_claims, public_contacts, overrides_as_of, typed_cells, delivery_states, digest_texts, sitemap_urls)}
SQL = {"draft_texts": DRAFT_TEXTS, "draft_checks": DRAFT_CHECKS, "approved_claims": APPROVED_CLAIMS, "public_contacts": PUBLIC_CONTACTS, "overrides_as_of": OVERRIDES_AS_OF, "typed_cells": TYPED_CELLS, "delivery_states": DELIVERY_STATES, "digest_texts": DIGEST_TEXTS, "sitemap_urls": SITEMAP_URLS}
