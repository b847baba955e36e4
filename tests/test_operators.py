"""Reports, lifecycle, planner, outbox, contacts, workflow, upsert, components and streams."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarnwick import scratch
from tarnwick.operators import contacts, digest, lifecycle, outbox, planner, reports, upsert, workflow
from tarnwick.operators.components import connected_components
from tarnwick.streaming import runner

NOW = datetime(2026, 8, 15, 8)


def now():
    return F.lit("2026-08-15 08:00:00").cast("timestamp")


def dashboard(spark, extra_job=False):
    jobs = [("j1", "Atlas", "BACKEND", "2026-08-01T00:00:00Z", "HOT_0_6H"), ("j2", "atlas", "BACKEND", "2026-08-01T00:00:00Z", ""), ("j3", "Beta", "PLATFORM", "2026-08-02T00:00:00Z", None), ("j4", "Gamma", "", "2026-08-02T00:00:00Z", "HOT_0_6H")]
    jobs += [jobs[0]] if extra_job else []
    apps = [(1, "j1", "2026-08-01T02:00:00Z", "APPLIED"), (2, "j2", "2026-08-01T06:00:00Z", "ACCEPTED"), (3, "j3", "2026-07-01T00:00:00Z", "REJECTED"), (4, "j4", "2026-09-01T00:00:00Z", "OFFER")]
    seen = [(1, "j1", "board"), (2, "j1", "mail"), (3, "j2", ""), (4, "j3", "board")]
    events = [("j1", "TECH_SCREEN"), ("j1", "TECH_SCREEN"), ("j4", "HM_ROUND")]
    sent = [("j1", "SENT_MANUALLY", "2026-08-03T00:00:00Z", "positive"), ("j1", "REPLIED", "2026-08-03T00:00:00Z", ""), ("j2", "DRAFTED", None, ""), ("j3", "SENT_MANUALLY", "2026-09-03T00:00:00Z", ""), ("zz", "REPLIED", "2026-08-03T00:00:00Z", "")]
    make = spark.createDataFrame
    return reports.record_facts(
        make(jobs, "job_uid string, company string, role_family string, first_seen_at string, freshness_band string"), make(apps, "pos int, job_uid string, applied_at string, application_stage string"), make(seen, "pos int, job_uid string, source_id string"),
        make([(1, "ATLAS", "1"), (2, "beta", "0")], "pos int, company string, company_tier string"), make(events, "job_uid string, to_stage string"), make(sent, "job_uid string, outreach_stage string, sent_at string, reply_state string"), now(),
    )


def test_dashboard(spark):
    facts = dashboard(spark).cache()
    assert tuple(reports.funnel(facts).first()) == (3, 1, 1, 1)
    assert tuple(reports.apply_hours(facts).first()) == (4.0, 2)
    got = {(r["dimension"], r["label"]): (r["applications"], r["interviews"], r["sent"], r["replied"], r["interview_rate"], r["reply_rate"]) for r in reports.cohorts(facts).collect()}
    assert got["source", "board"] == (2, 1, 2, 2, 0.5, 1.0) and got["source", "UNATTRIBUTED"] == (1, 0, 0, 0, 0.0, None)
    assert got["tier", "Tier 1"][:2] == (2, 1) and got["tier", "Tier 0"][:2] == (1, 0) and got["tier", "UNASSIGNED"] == (0, 0, 0, 0, None, None) and got["role", "UNKNOWN"][0] == 0
    assert {r["label"]: r["n"] for r in reports.distribution(facts, "freshness_band").collect()} == {"HOT_0_6H": 2, "UNKNOWN": 2}


def test_dashboard_refuses_duplicate_records(spark):
    with pytest.raises(PySparkException, match="DUPLICATE_CANONICAL_JOB_UID"):
        dashboard(spark, extra_job=True).collect()


def test_action_queue(spark):
    make = spark.createDataFrame
    jobs = make([("a", "P1", "2026-08-15 13:00 IST", "do"), ("b", "P0", "2026-08-16 10:00 IST", "do"), ("c", "P0", "2026-08-15 10:00 IST", "do"), ("d", "P3", "", ""), ("e", "P0", "", ""), ("f", "P1", "2026-08-15T09:00", "x")], "job_uid string, action_priority string, action_by_ist string, next_action string")
    apps = make([(1, "e", "REJECTED", "", "", ""), (2, "b", "APPLIED", "call", "", "AGREED")], "pos int, job_uid string, application_stage string, next_step string, next_step_due string, referral_stage string")
    drafts = make([(1, "a", "DRAFTED", "2026-08-20"), (2, "a", "SENT_MANUALLY", "2026-08-14 09:00")], "pos int, job_uid string, outreach_stage string, follow_up_due string")
    rows = reports.action_queue(jobs, apps, drafts, "2026-08-15 13:30").collect()
    assert [(r["job_uid"], r["overdue"]) for r in rows] == [("c", "OVERDUE"), ("b", ""), ("a", "OVERDUE"), ("f", "")]
    assert rows[1]["next_action"] == "call" and rows[2]["outreach_stage"] == "SENT_MANUALLY"


@pytest.mark.parametrize(("counts", "today", "hit"), [([20] * 3, 6, False), ([20] * 3, 5, True), ([20] * 2, 0, False), ([9] * 5, 0, False), ([10, 10, 30], 2, True)])
def test_anomaly(spark, counts, today, hit):
    history = [("s", n * 86_400, c) for n, c in enumerate(counts)] + [("s", len(counts) * 86_400, today)]
    found = lifecycle.yield_anomalies(spark.createDataFrame(history, "k string, at long, n long"), "k", "at", "n").where(f"at = {len(counts) * 86_400}")
    assert (found.count() == 1) is hit


def test_miss_counters(spark):
    seen = [("a", "j1", True, True), ("b", "j1", False, True), ("c", "j2", False, True), ("d", "j2", False, False), ("e", "j3", False, True)]
    counts = [("a", 2, NOW - timedelta(days=1)), ("b", 1, NOW - timedelta(hours=11)), ("c", 2, NOW - timedelta(hours=12)), ("d", 1, None)]
    frame = lifecycle.miss_counters(spark.createDataFrame(seen, "appearance_uid string, job_uid string, seen boolean, eligible boolean"), spark.createDataFrame(counts, "appearance_uid string, misses int, last_missing_at timestamp"), now())
    assert {r["appearance_uid"]: r["misses"] for r in frame.collect()} == {"a": 0, "b": 1, "c": 3, "d": 1, "e": 1}
    assert {r["job_uid"]: r["state"] for r in lifecycle.closure(frame).collect()} == {"j1": "ACTIVE", "j2": "ACTIVE", "j3": "ACTIVE"}


@pytest.mark.parametrize(("misses", "hours", "state", "complete", "seen", "closed", "wanted"), [(1, 12, "ACTIVE", True, False, False, (2, "POSSIBLY_CLOSED")), (1, 11, "ACTIVE", True, False, False, (1, "ACTIVE")), (2, 24, "POSSIBLY_CLOSED", True, False, False, (3, "CLOSED")), (3, 24, "CLOSED", True, True, False, (0, "REOPENED")), (0, 24, "ACTIVE", False, False, True, (0, "CLOSED"))])
def test_mark_missing(spark, misses, hours, state, complete, seen, closed, wanted):
    last = F.lit(str(NOW - timedelta(hours=hours))).cast("timestamp")
    x = spark.range(1).select(lifecycle.mark_missing(F.lit(misses), last, F.lit(state), now(), F.lit(complete), F.lit(seen), F.lit(closed)).alias("x")).first()["x"]
    assert (x["misses"], x["active_state"]) == wanted


def test_listing_presence(spark):
    jobs = spark.createDataFrame([("j1", "CLOSED", 10.0, 12.0, NOW - timedelta(hours=5)), ("j2", "CLOSED", 1.0, 1.0, NOW)], "job_uid string, active_state string, age_hours_min double, age_hours_max double, last_seen_at timestamp")
    seen = spark.createDataFrame([("s", "1", "j1"), ("s", "2", "j2")], "source_id string, external_job_id string, job_uid string")
    found = {r["job_uid"]: r for r in lifecycle.listing_presence(jobs, seen, spark.createDataFrame([("s", "1")], "source_id string, external_job_id string"), now()).collect()}
    assert (found["j1"]["active_state"], found["j1"]["age_hours_max"], found["j1"]["reopened"]) == ("REOPENED", 17.0, True) and found["j2"]["active_state"] == "CLOSED"


def test_change_event_precedence(spark):
    fields = "active_state string, apply_url string, deadline timestamp, location string, min_years double, max_years double, education_constraint string"
    base = ("ACTIVE", "u", NOW, "p", 1.0, None, "")
    cases = {"CLOSED": ("CLOSED", "v", NOW, "q", 1.0, None, ""), "APPLY_URL_REPLACED": ("ACTIVE", "v", NOW - timedelta(1), "q", 1.0, None, ""), "EARLIER_DEADLINE": ("ACTIVE", "u", NOW - timedelta(1), "q", 1.0, None, ""), "LOCATION_CHANGED": ("ACTIVE", "u", NOW, "q", 2.0, None, ""), "ELIGIBILITY_CHANGED": ("ACTIVE", "u", NOW, "p", 1.0, 2.0, ""), "": base}
    old = ", ".join("old_" + f for f in fields.split(", "))
    frame = spark.createDataFrame([(*base, *new, want) for want, new in cases.items()], f"{old}, {fields}, want string")
    assert frame.where(~lifecycle.record_change_event().eqNullSafe(F.col("want"))).count() == 0


def source(**changes):
    base = {"source_id": "s", "enabled": True, "policy_state": "APPROVED", "access_mode": "RSS_ATOM", "coverage_state": "VERIFIED_ACTIVE", "health_state": "HEALTHY", "backoff_until": None, "cost_class": "free", "policy_reviewed_at": NOW - timedelta(1), "policy_review_due_at": NOW + timedelta(1), "policy_evidence_url": "u", "policy_evidence_hash": "h", "human_reviewer": "r", "robots_allowed": True, "allowed_hosts": ["x.org"]}
    return tuple((base | changes).values())


POLICY = "source_id string, enabled boolean, policy_state string, access_mode string, coverage_state string, health_state string, backoff_until timestamp, cost_class string, policy_reviewed_at timestamp, policy_review_due_at timestamp, policy_evidence_url string, policy_evidence_hash string, human_reviewer string, robots_allowed boolean, allowed_hosts array<string>"


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ({}, None), ({"enabled": False, "cost_class": "paid"}, "SOURCE_NOT_APPROVED"), ({"policy_state": None}, "SOURCE_NOT_APPROVED"), ({"access_mode": "MANUAL"}, "ACCESS_MODE_NOT_AUTOMATED"), ({"coverage_state": "UNVALIDATED"}, "SOURCE_NOT_VERIFIED"), ({"health_state": "DOWN"}, "SOURCE_HEALTH_BLOCKED"),
        ({"backoff_until": NOW + timedelta(1)}, "BACKOFF_ACTIVE"), ({"cost_class": "paid"}, "ZERO_COST_REJECTED"), ({"policy_review_due_at": NOW}, "POLICY_EVIDENCE_MISSING_OR_OVERDUE"), ({"human_reviewer": None}, "POLICY_EVIDENCE_MISSING_OR_OVERDUE"), ({"robots_allowed": None}, "ROBOTS_NOT_APPROVED"), ({"allowed_hosts": ["y.org"]}, "UNAPPROVED_HOST"),
    ],
)
def test_policy_gate(spark, changes, reason):
    frame = spark.createDataFrame([source(**changes)], POLICY)
    assert frame.select(planner.policy_reason(F.lit("x.org"), now()).alias("x")).first()["x"] == reason


@pytest.mark.parametrize(
    ("outcome", "complete", "anomaly", "wanted"),
    [
        ("SUCCESS_COMPLETE", True, False, ("HEALTHY", 0, "COMPLETED")), ("SUCCESS_COMPLETE", False, False, ("DEGRADED", 2, "IN_PROGRESS")), ("FAILED_TRANSIENT", True, False, ("DOWN", 3, "NEW")), ("SUCCESS_COMPLETE", True, True, ("DEGRADED", 2, "NEW")), ("PAUSE", True, False, ("PAUSED", 2, "NEW")),
        ("REPAIR", True, False, ("UNKNOWN", 0, "NEW")), ("AUTH_REQUIRED", True, False, ("AUTH_REQUIRED", 2, "NEW")), ("BACKOFF", True, False, ("BACKOFF", 2, "NEW")), ("DEFERRED_BUDGET", True, False, ("DEGRADED", 2, "NEW")),
    ],
)
def test_source_transition(spark, outcome, complete, anomaly, wanted):
    row = ("s", True, "DEGRADED", 2, None, NOW - timedelta(hours=1), None, 24.0, "NEW", None, "APPROVED", outcome, complete, None, anomaly)
    schema = "source_id string, enabled boolean, health_state string, consecutive_failures int, backoff_until timestamp, last_success_at timestamp, last_attempt_at timestamp, cadence_hours double, baseline_state string, next_due_at timestamp, policy_state string, outcome string, complete boolean, new_backoff timestamp, anomaly boolean"
    r = planner.finish(spark.createDataFrame([row], schema), now()).first()
    assert (r["health_state"], r["consecutive_failures"], r["baseline_state"]) == wanted


def test_decisions_and_bundles(spark):
    jobs = spark.createDataFrame([(f"j{n}", 90.0 - n, "P0", "", False, None, None, "v") for n in range(7)] + [("old", 99.0, "P0", "", True, None, None, "v"), ("told", 80.0, "P1", "", False, None, None, "v2"), ("gray", 80.0, "P0", "X", False, None, None, "v")], "job_uid string, priority_score double, action_priority string, quarantine_reason string, baseline boolean, posted_at_source timestamp, age_hours_max double, material_version string")
    known = spark.createDataFrame([("x", "told", "P0")], "alert_id string, job_uid string, alert_type string")
    found = outbox.decisions(jobs, known, spark.createDataFrame([("told", "CLOSED"), ("j1", "CLOSED")], "job_uid string, event string"))
    assert sorted((r["job_uid"], r["alert_type"]) for r in found.collect()) == [*((f"j{n}", "P0") for n in range(7)), ("told", "UPDATE")]
    again = known.unionByName(found.select("alert_id", "job_uid", "alert_type"))
    assert outbox.decisions(jobs, again, spark.createDataFrame([], "job_uid string, event string")).count() == 0
    sent = spark.createDataFrame([(f"a{n}", "P0", "SENT", "b" if n < 3 else "", NOW, None) for n in range(16)] + [("p", "P0", "PENDING", "", NOW, None)], "alert_id string, alert_type string, state string, bundle_id string, created_at timestamp, sending_at timestamp")
    used = outbox.used_today(sent, now())
    assert used.first()["used"] == 14
    plan = outbox.bundle(found, used, [F.desc("priority_score"), F.col("job_uid")]).collect()
    assert [r["message"] for r in sorted(plan, key=lambda r: r["place"])] == ["SINGLE"] * 3 + ["BUNDLE"] * 5
    assert {r["state"] for r in outbox.claim(sent.unionByName(sent.limit(1).withColumn("state", F.lit("SENDING"))), now()).collect()} == {"SENT", "SENDING", "AMBIGUOUS"}


def test_contacts_rank_and_redaction(spark):
    schema = "contact_uid string, company string, name string, contact_origin string, relationship_basis string, current_company_confidence string, evidence_fetched_at timestamp, retention_expires_at timestamp, do_not_contact boolean, contactability_basis string, linkedin_url string, work_email string, whatsapp_allowed boolean"
    base = ("Acme Inc", "n", "USER_CSV")
    rows = [("c1", *base, "FIRST_DEGREE_IMPORTED", "USER_SUPPLIED_CURRENT", NOW, None, False, "", "", "e@x.org", False), ("c2", *base, "CLOSE_CONNECTION", "USER_SUPPLIED_CURRENT", NOW, None, False, "", "l", "", False), ("c3", *base, "AGREED_REFERRAL", "USER_SUPPLIED_CURRENT", NOW - timedelta(days=181), None, False, "", "", "", True), ("c4", *base, "X", "USER_SUPPLIED_CURRENT", NOW, NOW, False, "", "", "", True), ("c5", "acme", "n", "PERMITTED_JOB_POSTING", "", "", NOW, None, False, "EXPLICIT_RECRUITING_CHANNEL:x", "", "r@x.org", False), ("c6", *base, "X", "USER_SUPPLIED_CURRENT", NOW, None, True, "", "", "", True)]
    people = spark.createDataFrame(rows, schema)
    jobs = spark.createDataFrame([("j", "acme")], "job_uid string, normalized_company string")
    ranked = contacts.rank_contacts(jobs, people, now()).orderBy("rank").collect()
    assert [(r["contact_uid"], r["rank"], r["recommended_channel"]) for r in ranked] == [("c2", 1, "LINKEDIN"), ("c1", 2, "EMAIL"), ("c5", 3, "EMAIL")]
    gone = contacts.purge_expired(people, now()).where("redacted").collect()
    assert [r["contact_uid"] for r in gone] == ["c4"] and gone[0]["name"] is None and gone[0]["do_not_contact"]


def test_claims(spark):
    piece = "struct<allowed_in_outreach: boolean, allowed_atomic_claims: array<string>, forbidden_extrapolations: array<string>>"
    given = [
        [(True, [" ", "w " * 33, "Stealth work", "all of X", " Built a thing ", "Other"], ["ALL of"]), (True, ["Second"], None), (True, ["Third"], [])],
        [(False, ["Built a thing"], []), (True, ["Second"], [])],
        [(True, ["Same"], []), (True, ["Same"], [])],
        [(True, [" "], [])],
    ]
    frame = spark.createDataFrame([(n, e) for n, e in enumerate(given)], f"n int, e array<{piece}>")
    assert [r["x"] for r in frame.select("n", contacts.approved_claims(F.col("e")).alias("x")).orderBy("n").collect()] == [["Built a thing", "Second"], ["Second"], ["Same"], []]


@pytest.mark.parametrize(("body", "channel", "subject", "wanted"), [("w " * 130, "EMAIL", "s" * 60, None), ("w " * 129, "EMAIL", "", "WORDS_OUTSIDE_LIMIT"), ("w " * 130, "EMAIL", "s" * 61, "SUBJECT_TOO_LONG"), ("x" * 250, "LINKEDIN_CONNECTION", None, None), ("x" * 251, "LINKEDIN_CONNECTION", None, "NOTE_TOO_LONG"), ("Hi {Name}", "FOLLOW_UP", "", "UNRESOLVED_PLACEHOLDER"), ("Hi", "FOLLOW_UP", "[Link]", "UNRESOLVED_PLACEHOLDER"), ("10X faster", "FOLLOW_UP", "", "UNSAFE_CLAIM"), ("", "FOLLOW_UP", "", None), ("x", "FAX", "", "UNKNOWN_CHANNEL")])
def test_draft_errors(spark, body, channel, subject, wanted):
    frame = spark.createDataFrame([(body, channel, subject)], "b string, c string, s string")
    assert frame.select(contacts.draft_error(F.col("b"), F.col("c"), F.col("s")).alias("x")).first()["x"] == wanted


def test_contact_rules(spark):
    base = {"do_not_contact": False, "outreach_allowed": True, "reply_state": "NONE", "retention_expires_at": None, "contact_origin": "USER_CSV", "contactability_basis": "", "last_contacted_at": None, "follow_up_count": 0}
    at = datetime.fromisoformat
    cases = [
        ({}, True, False), ({"do_not_contact": True}, False, False), ({"outreach_allowed": None}, False, False), ({"reply_state": "REPLIED"}, False, False), ({"reply_state": "NO_REPLY"}, True, False),
        ({"contact_origin": "SCRAPED"}, False, False), ({"contact_origin": None, "contactability_basis": "EXPLICIT_RECRUITING_CHANNEL:page"}, True, False), ({"retention_expires_at": at("2024-03-15T12:00")}, False, False),
        ({"last_contacted_at": at("2024-03-08T12:00")}, False, True),  # Friday; seven days later
        ({"last_contacted_at": at("2024-03-08T12:01")}, False, False), ({"last_contacted_at": at("2024-03-09T12:00")}, False, True), ({"last_contacted_at": at("2024-03-10T12:00")}, False, True),
        ({"last_contacted_at": at("2024-03-11T12:00")}, False, False), ({"last_contacted_at": at("2024-02-14T12:00")}, True, True), ({"last_contacted_at": at("2024-02-14T12:00"), "follow_up_count": 1}, True, False),
    ]
    schema = "n int, do_not_contact boolean, outreach_allowed boolean, reply_state string, retention_expires_at timestamp, contact_origin string, contactability_basis string, last_contacted_at timestamp, follow_up_count int"
    frame = spark.createDataFrame([(n, *(base | change).values()) for n, (change, _, _) in enumerate(cases)], schema)
    moment = F.lit("2024-03-15T12:00:00").cast("timestamp")
    found = frame.select("n", contacts.can_contact(moment).alias("a"), contacts.can_contact(moment, follow_up=True).alias("b"), contacts.can_contact(moment, override_reason=F.lit("asked")).alias("c")).orderBy("n").collect()
    assert [(r["a"], r["b"]) for r in found] == [(a, b) for _, a, b in cases]
    assert all(r["c"] for r in found[8:])


@pytest.mark.parametrize(("before", "after", "why", "ok"), [("NOT_REVIEWED", "APPLIED", "", True), ("NOT_REVIEWED", "ACCEPTED", "", False), ("APPLIED", "REVIEWING", "", False), ("APPLIED", "REVIEWING", "CORRECTION: typo", True), ("REJECTED", "APPLIED", "", False), ("OFFER", "ACCEPTED", "", True), ("REVIEWING", "SKIPPED", "", False), ("REVIEWING", "SKIPPED", "no fit", True), ("X", "APPLIED", "", False)])
def test_transitions(before, after, why, ok):
    assert workflow.valid(before, after, why) is ok


def test_command_replay(spark):
    schema = "row_pos long, row_uid string, job_uid string, application_stage_update string, referral_stage_update string, outreach_stage_update string, update_note string, reason string, submit boolean, processed_payload_hash string"
    row = lambda n, job, stage, **k: (n, k.get("uid", f"r{n}"), job, stage, "", "", "", k.get("why", ""), k.get("submit", True), k.get("done", ""))
    commands = spark.createDataFrame([row(2, "j1", "APPLIED"), row(3, "j1", "REVIEWING"), row(4, "j1", "OFFER"), row(5, "zz", "APPLIED"), row(6, "j2", "APPLIED", uid="bad"), row(7, "j2", "APPLIED", submit=False), row(8, "j2", "APPLIED", done="other")], schema)
    issued = spark.createDataFrame([(n, f"r{n}") for n in range(2, 9)], "row_pos long, row_uid string")
    jobs, none = spark.createDataFrame([("j1",), ("j2",)], "job_uid string"), spark.createDataFrame([], "event_uid string")
    apps = spark.createDataFrame([], "job_uid string, application_stage string")
    first = workflow.replay(spark, workflow.triage(commands, issued, jobs, none), apps).cache()
    assert {r["row_pos"]: r["result"] for r in first.collect()} == {2: "APPLIED", 3: "INVALID_TRANSITION", 4: "APPLIED", 5: "UNKNOWN_JOB_UID", 6: "INVALID_ROW_UID", 8: "CHANGED_AFTER_SUBMIT"}
    second = workflow.replay(spark, workflow.triage(commands, issued, jobs, first.where("result = 'APPLIED'").select("event_uid")), spark.createDataFrame([("j1", "OFFER")], "job_uid string, application_stage string"))
    assert {r["row_pos"]: r["result"] for r in second.where("row_pos < 5").collect()} == {2: "REPLAY", 3: "INVALID_TRANSITION", 4: "REPLAY"}


SPEC = upsert.TableSpec("t", "k", ("k", "a", "note"), user_columns=("note",))


def test_upsert(spark):
    old = spark.createDataFrame([(1, "x", "mine"), (2, None, "b"), (3, "z", "c")], "k int, a string, note string")
    new = spark.createDataFrame([(1, "y", "theirs"), (2, None, "theirs"), (4, "n", "theirs")], "k int, a string, note string")
    assert {r["k"]: (r["a"], r["note"], r["change"]) for r in upsert.upsert(old, new, SPEC).collect()} == {1: ("y", "mine", "CHANGED"), 2: (None, "b", "SAME"), 3: ("z", "c", "KEPT"), 4: ("n", "theirs", "INSERTED")}
    final = upsert.TableSpec("t", "k", ("k", "a"), append_only=True)
    with pytest.raises(PySparkException, match="APPEND_ONLY_CONFLICT"):
        upsert.upsert(old, new, final).collect()
    assert upsert.upsert(old, old, final).where("change <> 'SAME'").count() == 0
    with pytest.raises(ValueError):
        upsert.verify_schema(old, final, "1", "1")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=25))
def test_components(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in list(parent)}


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    found = connected_components(spark, spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long"))
    assert found.count() == 300 and found.where("component <> 0").count() == 0


def test_stream_upserts_are_idempotent(spark, tmp_path):
    inbox, root, marks = (str(tmp_path / n) for n in ("in", "table", "marks"))
    schema = "k int, a string, note string"
    spark.createDataFrame([(1, "x", "n"), (2, "y", "n")], schema).coalesce(1).write.json(inbox)
    stream = spark.readStream.schema(schema).json(inbox)
    runner.start_upserts(stream, root, SPEC, marks).awaitTermination()
    spark.createDataFrame([(2, "z", "other")], schema).coalesce(1).write.mode("append").json(inbox)
    for _ in range(2):
        runner.start_upserts(stream, root, SPEC, marks).awaitTermination()
    assert {r["k"]: (r["a"], r["note"]) for r in runner.current(spark, root).collect()} == {1: ("x", "n"), 2: ("z", "n")}
    assert runner.versions(spark, root) == [0, 1]
    runner.commit_batch(root, SPEC)(spark.createDataFrame([(9, "q", "n")], schema), 1)
    assert runner.current(spark, root).count() == 2


def counted(rows, start):
    """Misses and state after each row, one row after the other."""
    state, out = dict(start), []
    for uid, at, seen, eligible in sorted(rows, key=lambda r: r[1]):
        misses, last = state.get(uid, (0, None))
        if seen:
            misses, last = 0, None
        elif eligible and (last is None or at - last >= timedelta(hours=12)):
            misses, last = misses + 1, at
        state[uid] = (misses, last)
        out.append((uid, at, misses, ("ACTIVE", "ACTIVE", "POSSIBLY_CLOSED", "CLOSED")[min(misses, 3)]))
    return sorted(out)


def test_misses_across_restarts(spark, tmp_path):
    """Three runs of one stream, each started anew, give what one pass over all rows gives."""
    inbox, marks, sink = (str(tmp_path / n) for n in ("in", "marks", "out"))
    schema = "appearance_uid string, at timestamp, seen boolean, eligible boolean"
    rng = random.Random(3)
    rows = [(uid, NOW + timedelta(hours=h), rng.random() < 0.2, rng.random() < 0.8) for uid in ("a", "b", "c") for h in sorted(rng.sample(range(150), 18))]
    start = {"a": (2, NOW - timedelta(hours=20)), "c": (1, None)}
    committed = spark.createDataFrame([(k, m, at) for k, (m, at) in start.items()], "appearance_uid string, misses int, last_missing_at timestamp")
    for lo, hi in ((0, 50), (50, 100), (100, 150)):
        part = [r for r in rows if lo <= (r[1] - NOW) / timedelta(hours=1) < hi]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = runner.miss_stream(spark.readStream.schema(schema).parquet(inbox), committed)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(sink).collect()
    assert sorted((r["appearance_uid"], r["at"], r["misses"], r["state"]) for r in found) == counted(rows, start)


def test_commits_rewrite_only_touched_buckets(spark, tmp_path):
    root, schema = str(tmp_path / "table"), "k int, a string, note string"
    batch = lambda rows: spark.createDataFrame(rows, schema)
    write = runner.commit_batch(root, SPEC, buckets=16)
    write(batch([(n, "x", "n") for n in range(200)]), 0)
    first = runner._manifest(spark, root, 0)
    assert len(first) == 16 and len(list((tmp_path / "table/data/v=0").glob("__bucket=*"))) == 16
    before = runner.current(spark, root)
    write(batch([(7, "new", "n"), (7, "newer", "n"), (500, "y", "n")]), 1)
    second = runner._manifest(spark, root, 1)
    moved = [b for b in first if first[b] != second[b]]
    assert 1 <= len(moved) <= 2 and len(list((tmp_path / "table/data/v=1").glob("__bucket=*"))) == len(moved)
    assert before.count() == 200  # a reader keeps the version that it opened
    assert runner.current(spark, root).count() == 201 and {r["a"] for r in runner.current(spark, root).where("k = 7").collect()} == {"newer"}
    assert runner.current(spark, root, 0).where("k = 7").first()["a"] == "x"
    # A batch that died before its commit row: its files are there, no reader sees them, and it is written again.
    (tmp_path / "table/data/v=2").mkdir()
    (tmp_path / "table/data/v=2/left-over.parquet").write_bytes(b"")
    assert runner.versions(spark, root) == [0, 1]
    write(batch([(1, "z", "n")]), 2)
    write(batch([(1, "again", "n")]), 2)
    assert runner.current(spark, root).where("k = 1").first()["a"] == "z"


def replayed(commands, stages):
    """One command after the other."""
    out, now, done = [], dict(stages), set()
    for pos, job, event, after, referral, why, early in sorted(commands):
        before = now.get(job, "NOT_REVIEWED")
        target, result = after or before, early
        if result is None:
            if (job, event) in done:
                result = "REPLAY"
            elif referral == "ODD" or not workflow.valid(before, target, why):
                result = "INVALID_TRANSITION"
            else:
                result, now[job] = "APPLIED", target
                done.add((job, event))
        out.append((pos, before, target if result == "APPLIED" else None, result))
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 1), (2, 7), (3, 1000)])
def test_commands_in_blocks_equal_one_after_the_other(spark, seed, block):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    rows = [(n, pick("hot", "hot", "j1", "j2"), f"e{rng.randint(0, 40)}", pick("", "UNHEARD", *workflow.STAGES), pick("", "", "", "ODD"), pick("", "", "because", "CORRECTION: x"), pick(None, None, None, "UNKNOWN_JOB_UID")) for n in rng.sample(range(400), 150)]
    stages = {"j1": "OFFER", "j2": "NOT_A_STAGE"}
    schema = "row_pos long, job_uid string, event_uid string, application_stage_update string, referral_stage_update string, reason string, result string"
    commands = spark.createDataFrame(rows, schema).withColumn("outreach_stage_update", F.lit("")).repartition(3)
    found = workflow.replay(spark, commands, spark.createDataFrame(list(stages.items()), "job_uid string, application_stage string"), block_rows=block)
    assert sorted((r["row_pos"], r["from_stage"], r["to_stage"], r["result"]) for r in found.collect()) == replayed(rows, stages)


def test_commands_of_small_records_need_no_rounds(spark, monkeypatch):
    """Events that recur after a rejected first try took a round each."""
    rows = [(n, f"j{n % 3}", f"e{n // 3 % 4}", workflow.STAGES[n * 7 % len(workflow.STAGES)], "", "CORRECTION: x" if n % 5 == 0 else "", None) for n in range(120)]
    schema = "row_pos long, job_uid string, event_uid string, application_stage_update string, referral_stage_update string, reason string, result string"
    names, table = [], workflow.scratch.table
    monkeypatch.setattr(workflow.scratch, "table", lambda spark, df, name, *rest: names.append(name) or table(spark, df, name, *rest))
    found = workflow.replay(spark, spark.createDataFrame(rows, schema).withColumn("outreach_stage_update", F.lit("")), spark.createDataFrame([], "job_uid string, application_stage string"))
    assert sorted((r["row_pos"], r["from_stage"], r["to_stage"], r["result"]) for r in found.collect()) == replayed(rows, {})
    assert not {"outcomes", "applied", "blocks"} & set(names)


def test_messages_are_claimed_whole_and_settled(spark):
    box = "alert_id string, state string, automatic_attempts int, sending_at timestamp, sent_at timestamp, message_id string, provider_message_id string, error string"
    empty = (None, None, None, None, None)
    rows = [("a", "PENDING", 0, *empty), ("b", "PENDING", None, *empty), ("c", "PENDING", 1, *empty), ("d", "PENDING", 0, *empty), ("e", "SENDING", 1, None, None, "m9", None, None), ("f", "PENDING", 0, *empty), ("g", "SENT", 1, *empty)]
    plans = spark.createDataFrame([("m1", "a"), ("m1", "b"), ("m2", "c"), ("m2", "d"), ("m3", "f"), ("m4", "zz")], "message_id string, alert_id string")
    claimed = outbox.claim_messages(spark.createDataFrame(rows, box), plans, now())
    assert {r["alert_id"]: (r["state"], r["message_id"]) for r in claimed.collect()} == {"a": ("SENDING", "m1"), "b": ("SENDING", "m1"), "c": ("PENDING", None), "d": ("PENDING", None), "e": ("SENDING", "m9"), "f": ("SENDING", "m3"), "g": ("SENT", None)}
    answers = spark.createDataFrame([("m1", "SENT", "p1", None), ("m3", None, None, "x")], "message_id string, state string, provider_message_id string, error string")
    settled = {r["alert_id"]: (r["state"], r["error"], r["provider_message_id"], r["sent_at"] is not None) for r in outbox.settle(claimed, answers, now()).collect()}
    assert settled["a"] == settled["b"] == ("SENT", "", "p1", True)
    assert settled["f"] == ("AMBIGUOUS", "TRANSPORT_RESPONSE_LOST", "", False) and settled["e"] == ("AMBIGUOUS", "INTERRUPTED_AFTER_SEND_CLAIM", None, False) and settled["c"][0] == "PENDING"


def test_digest_of_many_lines(spark):
    rows = [("d1", 2, float(n % 7), f"u{n:02d}", f"line {n}") for n in range(30)] + [("d1", 1, None, "z", "overdue"), ("d2", 1, 1.0, "a", "one")]
    found = {r["day"]: (r["n_entries"], r["text"]) for r in outbox.render_digests(spark.createDataFrame(rows, "day string, part int, score double, uid string, line string"), "day").collect()}
    lines = ["overdue"] + [x[4] for x in sorted(rows[:30], key=lambda x: (-x[2], x[3]))]
    assert found == {"d1": (31, "\n\n".join(lines[:20]) + "\n\n11 more"), "d2": (1, "one")}


def test_job_text(spark):
    schema = "job_uid string, company string, title string, posted_at_source timestamp, first_seen_at timestamp, identities array<struct<provider_job_id: string>>, apply_url string, fit_score double, priority_score double, reasons array<string>, gaps array<string>, action_by string, next_action string, salary_currency string, salary_min double, salary_max double, salary_period string, posted_at_confidence string, official_link_state string"
    row = ("j", "Acme", "Engineer", None, NOW, [("",), ("77",)], "https://x.org", 81.5, 90.0, ["a", "b", "c", "d"], [], "today", "apply", "INR", 1.0, 2.5, "ANNUAL", "MISSING", "VERIFIED_OFFICIAL")
    text = outbox.render_jobs(spark.createDataFrame([row], schema)).first()["text"].split("\n")
    assert text == ["Acme: Engineer", "posting date unknown, first seen 2026-08-15 13:30 IST", "ids: 77", "apply at: https://x.org", "fit 81.5, priority 90", "for: a; b; c", "gaps: none recorded", "act by today, next: apply", "pay: INR 1 to 2.5 ANNUAL", "dated MISSING, link VERIFIED_OFFICIAL"]


def test_finalization_and_repeats(spark):
    good = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    bad = spark.createDataFrame([("a", 1), ("a", 2), (" ", 3), ("", 4), (None, 5)], "k string, n int")
    assert {r["k"] for r in upsert.duplicate_keys(bad, "k").collect()} == {"a", " ", "", None}
    assert tuple(upsert.finalized({"t": (good, "k")}, "r1").first()) == ("r1", "COMMITTED", 0)
    assert tuple(upsert.finalized({"t": (good, "k"), "u": (bad, "k")}, "r1").first()) == ("r1", "REJECTED", 4)
    spec = upsert.TableSpec("t", "k", ("k", "n"))
    assert [tuple(r) for r in upsert.upsert(good, spark.createDataFrame([("a", 5), ("a", 9)], "k string, n int"), spec).where("k = 'a'").collect()] == [("a", 9, "CHANGED")]


def test_scratch_tables_go(spark):
    made = scratch.table(spark, spark.range(5), "x")
    assert made.count() == 5
    scratch.sweep(spark)
    with pytest.raises(PySparkException):
        spark.read.parquet(made.inputFiles()[0]).count()


def test_digest_items_and_attempts(spark):
    make = spark.createDataFrame
    jobs = make([("a", "P0", NOW, None, "ACTIVE"), ("b", "P1", NOW - timedelta(9), NOW, "CHANGED"), ("c", "P2", NOW, None, "ACTIVE"), ("d", "P0", NOW - timedelta(9), None, "ACTIVE")], "job_uid string, action_priority string, first_seen_at timestamp, last_changed_at timestamp, active_state string")
    apps = make([("a", "APPLIED", "", "2026-08-15 13:00 IST"), ("b", "APPLIED", "call", "2026-08-15 14:00 IST")], "job_uid string, application_stage string, next_step string, next_step_due string")
    sent = make([("c", "SENT_MANUALLY", "2026-08-01T00:00:00Z"), ("d", "CLOSED", "2026-08-01T00:00:00Z")], "job_uid string, outreach_stage string, follow_up_due string")
    alerts = make([("x", "d", "P0", "AMBIGUOUS", None)], "alert_id string, job_uid string, alert_type string, state string, scheduled_window_end timestamp")
    cursor = F.lit("2026-08-14 00:00:00").cast("timestamp")
    found = digest.digest_items(jobs, apps, sent, alerts, cursor, now())
    assert sorted((r["kind"], r["line"]) for r in found.collect()) == [("CHANGED", "b: CHANGED"), ("FOLLOW_UP", "c: review due follow-up"), ("NEW", "a: P0"), ("NEW", "d: P0"), ("OVERDUE", "a: APPLIED")]
    first = digest.digest_attempt("morning", now(), cursor, alerts, alerts)
    assert first.first()["alert_type"] == "DIGEST" and digest.digest_attempt("morning", now(), cursor, alerts.limit(0), alerts).first()["alert_type"] == "NO_CONTENT"
    assert digest.digest_attempt("morning", now(), cursor, alerts, alerts.unionByName(first.select(F.lit("y").alias("alert_id"), F.lit("").alias("job_uid"), "alert_type", "state", "scheduled_window_end"))).count() == 0


def test_failure_notices(spark):
    seen = spark.createDataFrame([("a", True, 3), ("b", True, 2), ("c", False, None), ("d", True, None), ("e", True, None)], "condition string, active boolean, due_failures int")
    state = spark.createDataFrame([("c", True, 1), ("d", True, 1), ("e", False, 4)], "condition string, was_active boolean, episode int")
    assert {r["condition"]: (r["kind"], r["episode"]) for r in digest.failure_notices(seen, state).collect()} == {"a": ("FAILURE", 1), "c": ("RECOVERY", 1), "e": ("FAILURE", 5)}


def test_schedules_and_kinds(spark):
    mode = lambda c: spark.range(1).select(digest.mode_of(F.lit(c)).alias("x")).first()["x"]
    assert mode("17 4,10,16 * * 0,6") == "incremental" and mode("53 20 * * *") == "full"
    with pytest.raises(PySparkException, match="UNKNOWN_SCHEDULE"):
        mode("* * * * *")


def test_checkpoints_need_committed_records(spark):
    make, good = spark.createDataFrame, "a" * 64
    rows = make([("s", "1", "j1", good), ("s", "2", "j2", good), ("s", "3", "j3", "A" * 64), ("s", "4", "j1", good)], "source_id string, external_job_id string, job_uid string, version string")
    keyed = rows.withColumn("key", F.concat(F.lit("checkpoint:"), digest.uid(F.col("source_id"), F.col("external_job_id"))))
    seen = make([("s", "1", "j1"), ("s", "2", "j2"), ("s", "3", "j3")], "source_id string, external_job_id string, job_uid string")
    assert [r["external_job_id"] for r in digest.valid_checkpoints(keyed, seen, make([("j1",), ("j3",)], "job_uid string")).collect()] == ["1"]


def test_backup_and_staging(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "k int, a string")
    digest.export_backup({"t": rows}, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b/t")).count() == 1
    paths = {digest.stage_import(spark, rows, str(tmp_path / "s"), b"same", b"k" * 40) for _ in range(2)}
    assert len(paths) == 1 and spark.read.parquet(paths.pop()).count() == 1
