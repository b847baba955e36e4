"""Drafts, follow-ups and briefs."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import contacts, outreach

NOW = datetime(2026, 8, 14, 8)
PAIRS = (
    "job_uid string, title string, company string, normalized_company string, apply_url string, identities array<struct<provider_job_id: string>>, required_skills array<string>, role_family string, sequence int, action_priority string, action_eligibility string, claims array<string>, evidence_ids array<string>, "
    "contact_uid string, name string, contact_company string, contact_origin string, relationship_basis string, current_company_confidence string, evidence_fetched_at timestamp, linkedin_url string, work_email string, phone string, whatsapp_allowed boolean, stated array<string>, "
    "do_not_contact boolean, outreach_allowed boolean, reply_state string, retention_expires_at timestamp, contactability_basis string, last_contacted_at timestamp, follow_up_count int"
)
RECORD = ("j1", "Engineer", "Acme Ltd", "acme", "https://x.org/1", [("",), ("77",)], ["Java", "SQL"], "BACKEND", 2, "P0", "READY", ["Built a service that answers a thousand calls a second on two small machines", "Wrote the tests of a ledger that two teams use each day."], ["e1", "e2"])
PERSON = ("c1", "Ada", "ACME Pvt Ltd", "USER_CSV", "FORMER_COLLEAGUE", "USER_SUPPLIED_CURRENT", NOW - timedelta(days=3), "https://in/ada", "ada@x.org", "+911234567890", True, ["linkedin_url", "work_email", "phone"], False, True, "NONE", None, "", None, 0)
NAMES = [x.split()[0] for x in PAIRS.replace("array<struct<provider_job_id: string>>", "x").split(", ")]


def pair(record=(), person=None, **changes):
    row = dict(zip(NAMES, RECORD + (person or PERSON), strict=True)) | changes
    return tuple(row[n] for n in NAMES)


def made(spark, *rows):
    none = spark.createDataFrame([], "draft_id string")
    found = outreach.generate_drafts(spark.createDataFrame(list(rows), PAIRS), none, F.lit(str(NOW)).cast("timestamp"), "A. Candidate")
    return {r["channel"]: r for r in found.collect()}


def test_all_channels_of_a_known_contact(spark):
    found = made(spark, pair())
    assert set(found) == {"APPLICATION_NOTE", "LINKEDIN_MESSAGE", "LINKEDIN_CONNECTION", "EMAIL", "WHATSAPP"}
    assert all(r["error"] is None for r in found.values())
    assert {k: r["purpose"] for k, r in found.items()} == {"APPLICATION_NOTE": "APPLICATION", "LINKEDIN_MESSAGE": "REFERRAL", "LINKEDIN_CONNECTION": "CONNECT", "EMAIL": "REFERRAL", "WHATSAPP": "REFERRAL"}
    for channel, (least, most) in contacts.WORD_LIMITS.items():
        if channel in found:
            assert least <= found[channel]["words"] == len(found[channel]["text"].split()) <= most
    assert found["EMAIL"]["subject"] == "Engineer - 77" and found["APPLICATION_NOTE"]["contact_uid"] == ""
    assert "{" not in "".join(r["text"] for r in found.values()) and "posting 77" in found["EMAIL"]["text"] and "Java, SQL" in found["EMAIL"]["text"] and found["EMAIL"]["text"].startswith("Hello Ada,")
    assert (found["WHATSAPP"]["evidence_ids"], found["LINKEDIN_CONNECTION"]["evidence_ids"], found["EMAIL"]["evidence_ids"]) == (["e1"], [], ["e1", "e2"])


@pytest.mark.parametrize(
    ("changes", "channels"),
    [
        ({"action_priority": "P2"}, set()), ({"action_eligibility": "NEEDS_REVIEW"}, set()), ({"claims": []}, set()), ({"contact_uid": None}, {"APPLICATION_NOTE"}), ({"do_not_contact": True}, {"APPLICATION_NOTE"}), ({"last_contacted_at": NOW - timedelta(days=5)}, {"APPLICATION_NOTE"}),
        ({"stated": ["work_email"]}, {"APPLICATION_NOTE", "EMAIL"}), ({"whatsapp_allowed": None, "stated": ["phone"]}, {"APPLICATION_NOTE"}), ({"title": "E" * 240, "stated": ["linkedin_url"]}, {"APPLICATION_NOTE", "LINKEDIN_MESSAGE"}),
    ],
)
def test_gates(spark, changes, channels):
    assert set(made(spark, pair(**changes))) == channels


def test_strangers_are_asked_for_the_way_only(spark):
    found = made(spark, pair(contact_origin="PUBLIC_PAGE", contactability_basis="EXPLICIT_RECRUITING_CHANNEL: page"))
    assert found["EMAIL"]["purpose"] == "ROLE_INQUIRY" and outreach.ASKS[False][0] in found["EMAIL"]["text"]
    old = made(spark, pair(evidence_fetched_at=NOW - timedelta(days=181)))
    assert old["EMAIL"]["purpose"] == "ROLE_INQUIRY"


def test_known_drafts_and_limits(spark):
    frame = spark.createDataFrame([pair(), pair(contact_uid="c2", name="")], PAIRS)
    at = F.lit(str(NOW)).cast("timestamp")
    first = outreach.generate_drafts(frame, spark.createDataFrame([], "draft_id string"), at, "A").cache()
    assert first.count() == 9  # one application note, four channels for each contact
    assert outreach.generate_drafts(frame, first, at, "A").count() == 0
    changed = spark.createDataFrame([pair(sequence=3)], PAIRS)
    assert outreach.generate_drafts(changed, first, at, "A").count() == 5
    wrong = made(spark, pair(claims=["exactly-once Kafka for all"], evidence_ids=["e1"]))
    assert wrong["EMAIL"]["error"] == "UNSAFE_CLAIM"


def test_follow_up(spark):
    rows = [pair(last_contacted_at=NOW - timedelta(days=7)), pair(contact_uid="c2", last_contacted_at=NOW - timedelta(days=4)), pair(contact_uid="c3", last_contacted_at=NOW - timedelta(days=9), follow_up_count=1), pair(contact_uid="c4")]
    found = outreach.generate_follow_ups(spark.createDataFrame(rows, PAIRS), F.lit(str(NOW)).cast("timestamp")).collect()
    assert [(r["contact_uid"], r["channel"], r["error"]) for r in found] == [("c1", "FOLLOW_UP", None)] and "Engineer at Acme Ltd" in found[0]["text"]


def test_brief(spark):
    schema = (
        "job_uid string, sequence int, company string, title string, identities array<struct<provider_job_id: string>>, apply_url string, canonical_url string, official_link_state string, location string, posted_at_source timestamp, posted_at_confidence string, first_seen_at timestamp, deadline timestamp, active_state string, description string, "
        "required_skills array<string>, role_family string, claims array<string>, evidence_ids array<string>, gaps array<string>, exclusion_reason string, quarantine_reason string, action_priority string, action_by string, fit_score double, priority_score double, salary_min double, salary_max double, salary_currency string, salary_period string, referral_policy string, referral_wait_hours double"
    )
    row = lambda priority, **k: tuple((dict(zip([x.split()[0] for x in schema.replace("array<struct<provider_job_id: string>>", "x").split(", ")], ("j1", 4, "Acme", "Engineer", [("77",)], "https://a", "https://c", "VERIFIED_OFFICIAL", "Pune", NOW, "EXACT", NOW, None, "ACTIVE", "You design services. Lunch is free; Java skills required", ["Java"], "BACKEND", ["Built it"], ["e1"], [], "", "", priority, "soon", 80.0, 90.0, 1.0, 2.0, "INR", "ANNUAL", None, None), strict=True)) | k).values())
    found = outreach.briefs(spark.createDataFrame([row("P0"), row("P2"), row("P1", job_uid="j2", posted_at_source=None, referral_policy="REFERRAL_BEFORE_APPLY", referral_wait_hours=3.0, salary_min=None, quarantine_reason="odd")], schema), F.lit(str(NOW)).cast("timestamp"))
    by = {r["job_uid"]: (r["brief_uid"], r["confidence"], json.loads(r["brief"])) for r in found.collect()}
    assert set(by) == {"j1", "j2"} and by["j1"][:2] == ("brief_j1_4", "SOURCE_BACKED") and by["j2"][1] == "REQUIRES_VERIFICATION"
    first, second = by["j1"][2], by["j2"][2]
    assert [r["quote"] for r in first["facts"]["requirements"]] == ["You design services", "Java skills required"] and len(first["facts"]["summary"]) == 3
    assert first["inference"]["themes"] == ["Java", "API design and reliability", "Testing failure modes"] and first["inference"]["search_phrases"][0] == "site:linkedin.com/in Acme recruiter BACKEND India"
    assert first["inference"]["application_sequence"]["wait_hours"] == 1.0 and second["inference"]["application_sequence"]["wait_hours"] == 3.0
    assert first["facts"]["posted_at"] == "2026-08-14 13:30 IST" and first["facts"]["compensation"]["salary_max"] == 2.0 and "compensation" not in second["facts"]
    assert first["risks"] == [] and second["risks"] == ["odd", "AGE_UNKNOWN"] and first["evidence"] == [{"evidence_id": "e1", "claim": "Built it"}]


def test_texts_are_written_after_notes_are_made_one(spark):
    """Many contacts of one record: sorting whole texts took one task's memory."""
    none = spark.createDataFrame([], "draft_id string")
    rows = [pair(contact_uid=f"c{n}", name=f"Ada {n}") for n in range(40)]
    found = outreach.generate_drafts(spark.createDataFrame(rows, PAIRS), none, F.lit(str(NOW)).cast("timestamp"), "A. Candidate")
    channels = [r["channel"] for r in found.select("channel").collect()]
    assert channels.count("APPLICATION_NOTE") == 1 and channels.count("EMAIL") == 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("keep this message") < plan.index("Aggregate") and plan.rindex("keep this message") < plan.index("Aggregate")
