"""Contact matching, redaction and what drafts may say (CTC-01 to 03, JON-03/10/11, WIN-01/03, PRD-04/10/11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.text import normalized_company
from tarnwick.operators.ordered import numbered

USER_ORIGINS = ("LINKEDIN_CONNECTIONS_EXPORT", "GOOGLE_CONTACTS_EXPORT", "USER_CSV", "USER_ENTERED")
CLOSE = ("CLOSE_CONNECTION", "CURRENT_COLLEAGUE", "FORMER_COLLEAGUE")
PERSONAL = ("name", "work_email", "linkedin_url", "phone")


def rank_contacts(jobs: DataFrame, contacts: DataFrame, now: Column, top: int | None = None) -> DataFrame:
    """CTC-01: contacts of each record's company, closest first, with why and whether a referral was agreed.

    The rank depends on the company alone: contacts are ranked and cut to ``top`` per
    company before they meet records. The cut is a limit on each task's rows first, so
    no company's contacts are gathered. Without ``top`` all are ranked by ranges.
    """
    c = F.col
    usable = contacts.where(~F.coalesce(c("do_not_contact"), F.lit(False)) & (F.coalesce("company", F.lit("")) != "") & ~F.coalesce(c("retention_expires_at") <= now, F.lit(False)))
    own = c("contact_origin").isin(*USER_ORIGINS)
    fresh = (c("current_company_confidence") == "USER_SUPPLIED_CURRENT") & (c("evidence_fetched_at") >= F.timestamp_add("DAY", F.lit(-180), now))
    open_channel = F.startswith(F.coalesce("contactability_basis", F.lit("")), F.lit("EXPLICIT_RECRUITING_CHANNEL:"))
    strength = F.when(own & fresh, F.when(c("relationship_basis").isin(*CLOSE), 0).when(c("relationship_basis") == "FIRST_DEGREE_IMPORTED", 1).otherwise(2)).when(~own & open_channel, 3)
    kind = F.when(own, F.when(c("relationship_basis") == "AGREED_REFERRAL", "CONFIRMED_REFERRER").otherwise("WARM_CONNECTION")).otherwise("PERMITTED_RECRUITER")
    channel = F.when(F.coalesce("linkedin_url", F.lit("")) != "", "LINKEDIN").when(F.coalesce("work_email", F.lit("")) != "", "EMAIL").when(c("whatsapp_allowed"), "WHATSAPP").otherwise("")
    why = F.when(own, F.concat(F.lit("OWN_RELATIONSHIP:"), F.coalesce("relationship_basis", F.lit("UNKNOWN")))).otherwise(c("contactability_basis"))
    told = usable.select("contact_uid", normalized_company(c("company")).alias("normalized_company"), strength.alias("strength"), kind.alias("candidate_type"), channel.alias("recommended_channel"), why.alias("why"), (kind == "CONFIRMED_REFERRER").alias("agreed")).where("strength is not null")
    order = [c("strength").asc(), c("contact_uid").asc()]
    if top is None:
        ranked = numbered(jobs.sparkSession, told, order, ["normalized_company"]).withColumn("rank", c("rank").cast("int"))
    else:
        ranked = told.withColumn("rank", F.row_number().over(Window.partitionBy("normalized_company").orderBy(*order))).where(c("rank") <= top)
    return jobs.select("job_uid", "normalized_company").join(ranked, "normalized_company").drop("normalized_company")


def public_contact(allowed_host: Column) -> Column:
    """CTC-02: whether an observed contact is an explicit recruiting channel of an approved page."""
    c = F.col
    email = F.lower(F.coalesce("observed_email", F.lit("")))
    explicit = F.coalesce("evidence", F.lit("")).rlike(r"(?i)recruit|talent|hiring|careers")
    return c("approved") & allowed_host & explicit & email.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$") & F.contains(F.lower("evidence"), email)


def suppress(contacts: DataFrame, suppressed: DataFrame) -> DataFrame:
    """JON-10."""
    return contacts.join(suppressed.select("suppression_token"), "suppression_token", "left_anti")


def redacted(contacts: DataFrame, when: Column) -> DataFrame:
    """CTC-03: a tombstone keeps only the identity and the token."""
    return contacts.withColumns({p: F.when(~when, F.col(p)) for p in PERSONAL if p in contacts.columns} | {"do_not_contact": F.coalesce("do_not_contact", F.lit(False)) | when, "redacted": when})


def purge_expired(contacts: DataFrame, now: Column) -> DataFrame:
    return redacted(contacts, F.coalesce(F.col("retention_expires_at") <= now, F.lit(False)))


def redaction_cascade(outreach: DataFrame, gone: DataFrame) -> DataFrame:
    """JON-11: texts to redacted contacts are blanked and closed."""
    flagged = outreach.join(gone.select("contact_uid", F.lit(True).alias("gone")).distinct(), "contact_uid", "left")
    hit = F.coalesce("gone", F.lit(False))
    return flagged.withColumns({"text": F.when(~hit, F.col("text")), "outreach_stage": F.when(hit, "DO_NOT_CONTACT").otherwise(F.col("outreach_stage"))}).drop("gone")


# Words a text may not claim, words of a text by channel (least, most), and other lengths.
UNSAFE_CLAIMS = ("stealth", "bypassed akamai", "defeated bot protection", "exactly-once kafka", "exactly once kafka", "10x faster", "10x lower latency", "10x throughput")
WORD_LIMITS = {"LINKEDIN_MESSAGE": (80, 160), "EMAIL": (130, 190), "WHATSAPP": (50, 90), "APPLICATION_NOTE": (120, 220), "FOLLOW_UP": (0, 90)}
NOTE_CHARS, SUBJECT_CHARS, CLAIM_WORDS = 250, 60, 32


def _words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def five_business_days(start: Column) -> Column:
    """Monday to Friday start a full week; from a weekend the fifth weekday is the coming Friday."""
    day = F.weekday(start)
    return F.timestamp_add("DAY", F.when(day == 5, 6).when(day == 6, 5).otherwise(7), start)


def can_contact(now: Column, follow_up: bool = False, override_reason: Column | None = None) -> Column:
    """PRD-04: permission, reply state, retention and origin; then a 30-day pause, or one follow-up after five business days.

    A given reason lifts the pause only. Unknown flags count against a contact.
    """
    c, no = F.col, lambda x: ~F.coalesce(x, F.lit(False))
    open_channel = F.startswith(F.coalesce("contactability_basis", F.lit("")), F.lit("EXPLICIT_RECRUITING_CHANNEL:"))
    known = F.coalesce(c("contact_origin").isin(*USER_ORIGINS), F.lit(False)) | open_channel
    allowed = no(c("do_not_contact")) & F.coalesce("outreach_allowed", F.lit(False)) & F.coalesce(c("reply_state").isin("NONE", "NO_REPLY"), F.lit(False)) & no(c("retention_expires_at") <= now) & known
    last = c("last_contacted_at")
    if follow_up:
        return allowed & F.coalesce((F.coalesce("follow_up_count", F.lit(0)) == 0) & (now >= five_business_days(last)), F.lit(False))
    reason = F.trim(F.coalesce(override_reason, F.lit(""))) if override_reason is not None else F.lit("")
    return allowed & (no(last > F.timestamp_add("DAY", F.lit(-30), now)) | (reason != ""))


def approved_claims(evidence: Column) -> Column:
    """PRD-10: distinct claims, the first that fits of each permitted one of the first two pieces of evidence.

    evidence: array of (allowed_in_outreach, allowed_atomic_claims, forbidden_extrapolations).
    A claim fits with 1 to 32 words, none of which are unsafe or forbidden.
    """
    unsafe = F.array(*map(F.lit, UNSAFE_CLAIMS))

    def first_fit(e: Column) -> Column:
        denied = F.concat(unsafe, F.coalesce(e["forbidden_extrapolations"], F.array().cast("array<string>")))
        fits = F.filter(e["allowed_atomic_claims"], lambda x: _words(x).between(1, CLAIM_WORDS) & ~F.exists(denied, lambda d: F.contains(F.lower(x), F.lower(d))))
        return F.trim(F.get(fits, F.lit(0)))

    permitted = F.filter(F.slice(evidence, 1, 2), lambda e: F.coalesce(e["allowed_in_outreach"], F.lit(False)))
    return F.array_distinct(F.array_compact(F.transform(permitted, first_fit)))


def draft_error(text: Column, channel: Column, subject: Column | None = None) -> Column:
    """PRD-11: why a draft may not be used, or null."""
    subject = F.lit("") if subject is None else F.coalesce(subject, F.lit(""))
    open_field = F.concat(text, subject).rlike(r"(?i)\{\{|\}\}|\{(?:company|name|role)\}|\[(?:name|company|role|link)\]")
    unsafe = F.exists(F.array(*map(F.lit, UNSAFE_CLAIMS)), lambda d: F.contains(F.lower(text), d))
    limits = F.create_map(*[x for k, v in WORD_LIMITS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("least"), F.lit(v[1]).alias("most")))])
    limit = F.try_element_at(limits, channel)
    note = channel == "LINKEDIN_CONNECTION"
    return (
        F.when(open_field, "UNRESOLVED_PLACEHOLDER")
        .when(unsafe, "UNSAFE_CLAIM")
        .when(note & (F.length(text) > NOTE_CHARS), "NOTE_TOO_LONG")
        .when(~note & limit.isNull(), "UNKNOWN_CHANNEL")
        .when(~note & ~_words(text).between(limit["least"], limit["most"]), "WORDS_OUTSIDE_LIMIT")
        .when(F.length(subject) > SUBJECT_CHARS, "SUBJECT_TOO_LONG")
    )
