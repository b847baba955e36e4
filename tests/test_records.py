"""Normalization, scoring, resolution and the twelve authored observations."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.operators import normalize, resolve, score
from tarnwick.plans import observations, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("title", "body", "years", "wanted"),
    [
        ("Senior Engineer", "", None, ("EXCLUDED", "SENIOR")), ("Backend Engineer", "you lead a team of five", None, ("EXCLUDED", "SENIOR")), ("iOS Engineer", "", None, ("EXCLUDED", "OUT_OF_SCOPE")), ("Software Engineer II", "", None, ("EXCLUDED", "LEVEL_II_UNCLEAR")),
        ("Software Engineer II", "", 2.0, ("SOFTWARE", "STRETCH")), ("Platform Engineer", "tickets", None, ("PLATFORM", "REVIEW_SCOPE")), ("Platform Engineer", "you write code", None, ("PLATFORM", "EARLY_CAREER")), ("Research Engineer", "", None, ("DISTRIBUTED_SYSTEMS", "EARLY_CAREER")),
        ("JavaScript Engineer", "", None, ("BACKEND", "EARLY_CAREER")), ("Gardener", "", None, ("UNKNOWN", "UNKNOWN")),
    ],
)
def test_roles(spark, title, body, years, wanted):
    assert tuple(one(spark, normalize.classify_role(F.lit(title), F.lit(body), F.lit(years).cast("double")))) == wanted


@pytest.mark.parametrize(
    ("body", "low", "high", "confidence"),
    [
        ("Needs 2-4 years of work", 2.0, 4.0, "PARSED"), ("3+ years", 3.0, None, "PARSED"), ("1 year. 3 to 5 years", 3.0, 5.0, "PARSED"), ("5-2 years", None, None, "AMBIGUOUS"), ("5 years preferred", None, None, "MISSING"), ("4 years of experience in Java", None, None, "MISSING"),
        ("4 years of software experience in Java", 4.0, None, "PARSED"), ("", None, None, "MISSING"), ("1 year; 9-2 years; 8 years", None, None, "AMBIGUOUS"),
    ],
)
def test_experience(spark, body, low, high, confidence):
    found = one(spark, normalize.parse_experience(F.lit(body)))
    assert (found["minimum"], found["maximum"], found["confidence"]) == (low, high, confidence)


@pytest.mark.parametrize(
    ("provider", "payload", "wanted"),
    [
        ("greenhouse", '[{"title": "Base pay", "min_cents": 100, "max_cents": 200, "currency": "inr", "period": "year"}]', ("base", 1.0, 2.0, "INR", "ANNUAL")), ("greenhouse", "[{}, {}]", None),
        ("jsonld", '{"currency": "USD", "value": {"minValue": 1, "maxValue": 2, "unitText": "HOUR"}}', ("base", 1.0, 2.0, "USD", "HOURLY")), ("lever", '{"type": "total", "min": 5, "currency": "EUR", "interval": "odd"}', ("total", 5.0, 5.0, "EUR", "UNKNOWN")),
        ("lever", '{"type": "base", "min": 5, "max": 4, "currency": "EUR"}', None), ("lever", '{"type": "base", "min": true, "currency": "EUR"}', None), ("lever", "no", None), ("lever", None, None), ("lever", '{"min": 5, "currency": "EUR"}', None),
    ],
)
def test_salary(spark, provider, payload, wanted):
    found = one(spark, normalize.parse_salary(F.lit(provider), F.lit(payload).cast("string")))
    assert (tuple(found) if found else None) == wanted


@pytest.mark.parametrize(("place", "body", "wanted"), [("Pune", "", True), ("Berlin", "", None), ("Pune", "US only", False), ("Berlin", "visa sponsorship provided", True), ("Berlin", "status only", False)])
def test_eligibility(spark, place, body, wanted):
    assert one(spark, normalize.location_eligible(F.lit(place), F.lit(body))) is wanted


def test_skills_by_sentence(spark):
    found = one(spark, normalize.skills_by_sentence(F.lit("Java and SQL. Kafka preferred; Java is a bonus")))
    assert (found["required"], found["preferred"]) == (["Java", "SQL"], ["Kafka"])


def test_weights_must_total_one_hundred():
    with pytest.raises(ValueError):
        score.ScoringConfig(fit={"role": 50.0})


@pytest.mark.parametrize(
    ("stage", "exclusion", "route", "quarantined", "age", "wanted"),
    [
        ("APPLIED", "x", True, False, 1.0, ("PIPELINE", "TRACKING")), ("", "x", True, False, 1.0, ("EXCLUDED", "BLOCKED_HARD")), ("", "", True, False, 1.0, ("P0", "READY")), ("", "", True, False, 24.0, ("P1", "READY")), ("", "", True, False, 192.0, ("P2", "NEEDS_REVIEW")),
        ("", "", False, False, 1.0, ("P2", "NEEDS_OFFICIAL_LINK")), ("", "", True, True, 1.0, ("P2", "QUARANTINED")), ("", "", True, False, None, ("P2", "NEEDS_REVIEW")),
    ],
)
def test_ladder(spark, stage, exclusion, route, quarantined, age, wanted):
    step = score.ladder(F.lit(90.0), F.lit(90.0), F.lit(route), F.lit(age).cast("double"), F.lit(False), F.lit(False), F.lit(quarantined), F.lit(exclusion), F.lit(stage))
    assert tuple(one(spark, step)) == wanted


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for n, y in enumerate(b, 1):
            last, row[n] = row[n], last + 1 if x == y else max(row[n], row[n - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_similarity_is_the_longest_common_subsequence(a, b):
    wanted = 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
    assert resolve.similarity(a, b) == pytest.approx(wanted)


def test_replay_gives_nine_records(spark):
    found = records.replay(spark).select("company", "action_priority", "members").collect()
    counts = {p: sum(r["action_priority"] == p for r in found) for p in ("P0", "P1", "P2", "P3", "EXCLUDED")}
    assert len(found) == 9 and counts == {"P0": 2, "P1": 2, "P2": 3, "P3": 1, "EXCLUDED": 1}
    assert sum(r["members"] for r in found) == len(observations.rows()) == 12
