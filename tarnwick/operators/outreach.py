"""Draft texts, follow-ups and briefs; nothing is sent (CTC-04, CTC-05).

A draft is made for a record that is ready and of the two highest priorities, from
approved claims only. One without a contact is the note that goes with an application;
a contact who may be written to adds the channels that they gave. Ids follow from the
record, the contact, the channel, the purpose and the record's change number, so the
same draft is made once. Templates are filled by concatenation, in code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.dates import IST
from tarnwick.functions.text import normalized_company
from tarnwick.operators.contacts import USER_ORIGINS, can_contact, draft_error, five_business_days

# Texts by channel, with the names of what is filled in.
TEMPLATES = {
    "APPLICATION_NOTE": (
        "I am applying for {title} at {company} (posting {job_id}). The posting asks for {focus}, and that is the part of the work that I would like to do and have prepared for.\n\n"
        "What I can show for it: {claims} I am glad to go through the setting of these examples, the decisions behind them, and what they do not show. I have kept to what I can support and left out what I cannot.\n\n"
        "I would like to learn which problems this role takes on first and how the team decides that a change is ready. If a requirement of the posting is open to discussion, I am happy to talk about where I meet it and where I would still have to learn.\n\nPosting: {url}\n\n{candidate}"
    ),
    "LINKEDIN_MESSAGE": (
        "{greeting} I am looking at {title} at {company} (posting {job_id}), which mentions {focus}. I am writing about this one opening only. "
        "What I can show for it: {claims} I can explain how these examples came about and where their limits are. {ask} If this is not yours to answer, please feel free to leave it; I will apply in the official way in any case. Posting: {url}. Thank you for reading this."
    ),
    "EMAIL": (
        "{greeting}\n\nI am writing about {title} at {company} (posting {job_id}). The posting mentions {focus}, and I have tried to keep this message to what matters for that.\n\n"
        "What I can show for it: {claims} I am happy to explain how these examples came about and where their limits are. I would also like to understand what the team needs most in the coming months and how the requirements of the posting are weighed against one another.\n\n"
        "{ask} If you are not the right person for this, there is no need to answer. I will apply in the official way in any case. Posting: {url}\n\nThank you for your time.\n\n{candidate}"
    ),
    "WHATSAPP": (
        "{greeting} I am looking at {title} at {company} (posting {job_id}). One thing I can show for it: {claim} {short_ask} No need to answer if this is not a good time or not your team. I will apply in the official way in any case. Thank you."
    ),
    "LINKEDIN_CONNECTION": "Hello, I came across {title} at {company} and the part about {focus} is close to what I do. I would be glad to connect.",
    "FOLLOW_UP": "{greeting} a short note after my earlier message about {title} at {company}. If there is something that you think I should know, I would be glad to hear it. No need to answer, and I will not write again about this. Thank you.",
}
ASKS = {
    True: ("Would you be willing to refer me, but only if you think that the fit is right and are comfortable with it?", "Would you refer me, if you are comfortable with it?"),
    False: ("Could you tell me which way of applying is best, or what the team looks for most?", "Could you tell me which way of applying is best?"),
}
#: Hours from sight to application by priority.
APPLY_WITHIN = {"P0": 2.0, "P1": 12.0, "P2": 48.0, "P3": 168.0}


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with its names replaced; null values are empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p], F.lit("")) if n % 2 else F.lit(p) for n, p in enumerate(parts) if n % 2 or p])


def _closed(claim: Column) -> Column:
    return F.concat(F.rtrim(claim, F.lit(".")), F.lit("."))


def _warm(now: Column) -> Column:
    """A contact of the user's own, at the company by recent evidence."""
    own = F.col("contact_origin").isin(*USER_ORIGINS) & (F.col("relationship_basis") != "UNKNOWN")
    there = (normalized_company(F.coalesce("contact_company", F.lit(""))) == F.col("normalized_company")) & (F.col("current_company_confidence") == "USER_SUPPLIED_CURRENT")
    return F.coalesce(own & there & (F.col("evidence_fetched_at") >= F.timestamp_add("DAY", F.lit(-180), now)), F.lit(False))


def draft_id(job: Column, contact: Column, channel: Column, purpose: Column, sequence: Column) -> Column:
    return F.concat(F.lit("draft_"), F.substring(F.sha2(F.concat_ws("|", job, F.coalesce(contact, F.lit("")), channel, purpose, sequence.cast("string")), 256), 1, 24))


def generate_drafts(pairs: DataFrame, existing: DataFrame, now: Column, candidate: str, note_chars: int = 250, override_reason: Column | None = None) -> DataFrame:
    """CTC-04: draft_id, job_uid, contact_uid, channel, purpose, subject, text, evidence_ids, words, chars, error.

    pairs: job_uid, title, company, normalized_company, apply_url, identities,
    required_skills, role_family, sequence, action_priority, action_eligibility, claims
    (approved), evidence_ids, and of the contact, all null without one: contact_uid, name,
    contact_company, contact_origin, relationship_basis, current_company_confidence,
    evidence_fetched_at, linkedin_url, work_email, phone, whatsapp_allowed, stated (fields
    with provenance) and what can_contact reads. Drafts in existing are left out; one that
    breaks a limit carries an error and is not to be used.
    """
    c = F.col
    ready = pairs.where(c("action_priority").isin("P0", "P1") & (c("action_eligibility") == "READY") & (F.size("claims") > 0))
    warm, given = _warm(now), lambda name: (F.coalesce(name, F.lit("")) != "") & F.coalesce(F.array_contains("stated", F.lit(name)), F.lit(False))
    ids = F.filter(F.transform("identities", lambda i: i["provider_job_id"]), lambda x: F.coalesce(x, F.lit("")) != "")
    skills = F.array_join(F.slice("required_skills", 1, 3), ", ")
    values = {
        "title": c("title"), "company": c("company"), "job_id": F.coalesce(F.get(ids, F.lit(0)), "job_uid"), "focus": F.coalesce(F.nullif(skills, F.lit("")), F.lower(F.replace("role_family", F.lit("_"), F.lit(" ")))), "url": c("apply_url"), "candidate": F.lit(candidate),
        "claims": F.array_join(F.transform("claims", _closed), " "), "claim": _closed(F.get("claims", F.lit(0))), "greeting": F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("Hello "), "name", F.lit(","))).otherwise("Hello,"),
        "ask": F.when(warm, ASKS[True][0]).otherwise(ASKS[False][0]), "short_ask": F.when(warm, ASKS[True][1]).otherwise(ASKS[False][1]),
    }
    open_to = c("contact_uid").isNotNull() & can_contact(now, override_reason=override_reason)
    purpose = F.when(warm, "REFERRAL").otherwise("ROLE_INQUIRY")
    way = lambda channel, why, holds: F.when(holds, F.struct(F.lit(channel).alias("channel"), (why if isinstance(why, Column) else F.lit(why)).alias("purpose")))
    ways = F.array(
        way("APPLICATION_NOTE", "APPLICATION", F.lit(True)), way("LINKEDIN_MESSAGE", purpose, open_to & given("linkedin_url")), way("LINKEDIN_CONNECTION", "CONNECT", open_to & given("linkedin_url") & (F.length(fill(TEMPLATES["LINKEDIN_CONNECTION"], values)) <= note_chars)),
        way("EMAIL", purpose, open_to & given("work_email")), way("WHATSAPP", purpose, open_to & given("phone") & F.coalesce("whatsapp_allowed", F.lit(False))),
    )
    each = ready.withColumns({f"__{k}": v for k, v in values.items()} | {"__way": F.explode(F.array_compact(ways))})
    channel, note = c("__way.channel"), c("__way.channel") == "APPLICATION_NOTE"
    contact = F.when(note, "").otherwise(c("contact_uid"))
    evidence = F.when(channel == "WHATSAPP", F.slice("evidence_ids", 1, 1)).when(channel == "LINKEDIN_CONNECTION", F.array().cast("array<string>")).otherwise(c("evidence_ids"))
    subject = F.when(channel == "EMAIL", F.substring(F.concat("title", F.lit(" - "), "__job_id"), 1, 60)).otherwise("")
    # What a contact adds is left out of a note, so that notes of one record are alike.
    filled = [F.when(~note, c(f"__{k}")).alias(f"__{k}") if k in ("greeting", "ask", "short_ask") else c(f"__{k}") for k in values]
    asked = each.select(draft_id(c("job_uid"), contact, channel, c("__way.purpose"), c("sequence")).alias("draft_id"), "job_uid", contact.alias("contact_uid"), channel.alias("channel"), c("__way.purpose").alias("purpose"), subject.alias("subject"), evidence.alias("evidence_ids"), *filled)
    # The note of an application is the same whatever the contact: one of it stays. Its many copies go where they are,
    # by hashing; drafts are told apart by what fills them, and texts are written once that is done.
    notes = asked.where("channel = 'APPLICATION_NOTE'").distinct()
    told = notes.unionByName(asked.where("channel <> 'APPLICATION_NOTE'")).repartition("draft_id")
    once = told.groupBy("draft_id").agg(F.first(F.struct(*[c(n) for n in told.columns if n != "draft_id"])).alias("row")).select("draft_id", "row.*")
    held, text = {k: c(f"__{k}") for k in values}, F.lit(None).cast("string")
    for name, template in TEMPLATES.items():
        text = F.when(c("channel") == name, fill(template, held)).otherwise(text)
    once = once.select("draft_id", "job_uid", "contact_uid", "channel", "purpose", "subject", F.explode(F.array(text)).alias("text"), "evidence_ids")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return once.withColumns({"words": words, "chars": F.length("text"), "error": draft_error(c("text"), c("channel"), c("subject"))}).join(existing.select("draft_id"), "draft_id", "left_anti")


def generate_follow_ups(pairs: DataFrame, now: Column) -> DataFrame:
    """CTC-04: the one follow-up of each pair whose contact may get it."""
    c = F.col
    values = {"greeting": F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("Hello "), "name", F.lit(","))).otherwise("Hello,"), "title": c("title"), "company": c("company")}
    due = pairs.where(c("contact_uid").isNotNull() & can_contact(now, follow_up=True))
    uid = F.concat(F.lit("draft_"), F.substring(F.sha2(F.concat_ws("|", "job_uid", "contact_uid", F.lit("FOLLOW_UP")), 256), 1, 24))
    made = due.select(uid.alias("draft_id"), "job_uid", "contact_uid", F.lit("FOLLOW_UP").alias("channel"), F.lit("FOLLOW_UP").alias("purpose"), fill(TEMPLATES["FOLLOW_UP"], values).alias("text"))
    return made.withColumn("error", draft_error(c("text"), c("channel")))


def _local(x: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(F.from_utc_timestamp(x, IST), "yyyy-MM-dd HH:mm"), F.lit(" IST")), F.lit("UNKNOWN"))


def referral_plan(priority: Column, policy: Column, wait_hours: Column, first_seen: Column, due: Column) -> Column:
    """CTC-05: struct(policy, wait_hours, application_due, referral_review_due): how long an application may wait for a referral."""
    within = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in APPLY_WITHIN.items() for x in (F.lit(k), F.lit(v))]), priority), F.lit(0.0))
    known = F.coalesce(policy, F.lit("UNKNOWN"))
    waits = F.when(known.isin("APPLY_DIRECT", "REFERRAL_CAN_ATTACH_LATER"), 0.0).when(known == "REFERRAL_BEFORE_APPLY", F.least(within, F.greatest(F.lit(0.0), F.coalesce(wait_hours, within / 2)))).otherwise(within / 2)
    review = F.timestamp_add("MINUTE", F.when(priority == "P0", 30).otherwise(120), first_seen)
    return F.struct(known.alias("policy"), waits.alias("wait_hours"), due.alias("application_due"), _local(review).alias("referral_review_due"))


def manual_discovery(company: Column, family: Column) -> Column:
    """CTC-05: phrases to search for by hand."""
    phrases = (("site:linkedin.com/in ", company, " recruiter ", family, " India"), ("site:linkedin.com/in ", company, " engineering manager Bengaluru"), (company, " careers recruiting contact"), (company, " engineering blog ", family))
    return F.array(*[F.concat(*[F.coalesce(x, F.lit("")) if isinstance(x, Column) else F.lit(x) for x in phrase]) for phrase in phrases])


def briefs(scored: DataFrame, now: Column) -> DataFrame:
    """CTC-05: (brief_uid, job_uid, confidence, brief): a structured brief, as JSON, for every P0 and P1 record.

    scored: job_uid, sequence, company, title, identities, apply_url, canonical_url,
    official_link_state, location, posted_at_source, posted_at_confidence, first_seen_at,
    deadline, active_state, description, required_skills, role_family, claims, evidence_ids,
    gaps, exclusion_reason, quarantine_reason, action_priority, action_by, fit_score,
    priority_score, salary_min, salary_max, salary_currency, salary_period, referral_policy,
    referral_wait_hours.
    """
    c = F.col
    parts = F.filter(F.transform(F.split("description", r"[\n.;]"), lambda s: F.trim(s)), lambda s: s != "")
    asks = F.slice(F.filter(parts, lambda s: s.rlike(r"(?i)require|experience|skill|develop|build|design|degree|knowledge")), 1, 5)
    themes = F.slice(F.concat(F.slice("required_skills", 1, 3), F.array(F.lit("API design and reliability"), F.lit("Testing failure modes"), F.lit("Engineering trade-offs"))), 1, 3)
    pay = F.when(c("salary_min").isNotNull(), F.struct("salary_min", "salary_max", "salary_currency", "salary_period"))
    facts = F.struct(
        "company", "title", F.filter(F.transform("identities", lambda i: i["provider_job_id"]), lambda x: x != "").alias("job_ids"), "apply_url", "official_link_state", "location", _local(c("posted_at_source")).alias("posted_at"), "posted_at_confidence", _local(c("first_seen_at")).alias("first_seen"), _local(c("deadline")).alias("deadline"),
        "active_state", F.transform(asks, lambda s: F.struct(F.substring(s, 1, 250).alias("quote"), c("canonical_url").alias("source_url"))).alias("requirements"), F.transform(F.slice(parts, 1, 5), lambda s: F.substring(s, 1, 200)).alias("summary"), pay.alias("compensation"),
    )
    plan = referral_plan(c("action_priority"), c("referral_policy"), c("referral_wait_hours"), c("first_seen_at"), c("action_by"))
    inferred = F.struct(themes.alias("themes"), "gaps", F.when(F.coalesce("exclusion_reason", F.lit("")) != "", F.array("exclusion_reason")).otherwise(F.array().cast("array<string>")).alias("hard_gaps"), plan.alias("application_sequence"), _local(five_business_days(now)).alias("earliest_follow_up"), manual_discovery(c("company"), c("role_family")).alias("search_phrases"))
    backed = c("posted_at_source").isNotNull() & (c("official_link_state") == "VERIFIED_OFFICIAL")
    risks = F.array_compact(F.array(F.nullif(c("quarantine_reason"), F.lit("")), F.nullif(c("exclusion_reason"), F.lit("")), F.when(c("posted_at_source").isNull(), "AGE_UNKNOWN"), F.when(c("official_link_state") != "VERIFIED_OFFICIAL", "LINK_UNVERIFIED")))
    evidence = F.transform(F.arrays_zip("evidence_ids", "claims"), lambda x: F.struct(x["evidence_ids"].alias("evidence_id"), x["claims"].alias("claim")))
    whole = F.struct(facts.alias("facts"), evidence.alias("evidence"), inferred.alias("inference"), F.struct("fit_score", "priority_score", "action_priority").alias("score"), risks.alias("risks"))
    return scored.where(c("action_priority").isin("P0", "P1")).select(F.concat(F.lit("brief_"), "job_uid", F.lit("_"), c("sequence").cast("string")).alias("brief_uid"), "job_uid", F.when(backed, "SOURCE_BACKED").otherwise("REQUIRES_VERIFICATION").alias("confidence"), F.to_json(whole).alias("brief"))
