"""Text, URL, hash and date scalars at their boundaries."""

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import dates, hashing, text, urls
from tarnwick.plans import texts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x, kind="string"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(("given", "wanted"), [("  Straße & Co. ", "strasse co"), ("A--B", "a b"), ("", ""), ("ﬁne", "fine"), ("İX", "i x"), ("日本", "")])
def test_normalized_text(spark, given, wanted):
    assert one(spark, text.normalized_text(lit(given))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("Acme Pvt Ltd", "acme"), ("Acme, Inc.", "acme"), ("Inc", "inc"), ("Acme Limited Inc", "acme limited")])
def test_company(spark, given, wanted):
    assert one(spark, text.normalized_company(lit(given))) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("Java and C++ with K8s", ["C++", "Java", "Kubernetes"]), ("éjava x", []), ("javascript", ["JavaScript"]), ("we go home", ["Go"]), ("spring-boot, restful", ["REST APIs", "Spring Boot"]), ("java+", [])],
)
def test_skills(spark, given, wanted):
    assert one(spark, text.tags(lit(given))) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("Bearer abc.def, x", "Bearer [REDACTED], x"), ("password=hunter2&x", "password=[REDACTED]&x"), ("mail a.b@c.org now", "mail [EMAIL] now"), ("call +49 170 1234567 now", "call [PHONE] now"), ("é12345678901", "é12345678901")],
)
def test_redact(spark, given, wanted):
    assert one(spark, text.redact(lit(given))) == wanted


def test_redact_masks_each_text_once(spark, tmp_path):
    rows = [(1, "mail a@example.org, signature=x API-Key: y, +91 12345 67890"), (2, "nothing"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = texts.redact(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1, 2)]
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("regexp_replace(") == len(text.REDACTIONS)


@pytest.mark.parametrize(("given", "escaped"), [("=1+1", True), ("  @x", True), ("a=1", False), ("", False), ("\tx", True), ("-5", True)])
def test_safe_cell(spark, given, escaped):
    assert (one(spark, text.safe_cell(lit(given))) != given) is escaped


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("<p>a</p>b", "a b"), ("&lt;p&gt;x&lt;/p&gt;y", "x y"), ("a<script>no</script>b", "a b"), ("<b>a</b>c", "a c"), ("a<style>p{}</style>", "a"), (None, None), ("", "")],
)
def test_plain_text(spark, given, wanted):
    assert one(spark, text.plain_text(lit(given))) == wanted
    assert text.visible_text(given) == wanted


def test_first_sentence(spark):
    assert one(spark, text.first_sentence(lit("No. We sponsor visas; yes\nvisa"), "(?i)visa")) == "We sponsor visas"
    assert one(spark, text.first_sentence(lit("nothing"), "visa")) == ""


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("HTTPS://Example.COM:443/a?utm_source=x&b=2&a=1#f", ("https://example.com/a?a=1&b=2", None)), ("http://example.com", ("http://example.com/", None)), ("http://example.com:443/", ("http://example.com:443/", None)),
        ("ftp://x.org", (None, "URL_SCHEME_OR_HOST")), ("https://u:p@x.org", (None, "URL_CREDENTIALS_OR_PORT")), ("https://x.org:8080", (None, "URL_CREDENTIALS_OR_PORT")), ("https://x.org/?my_token=1", (None, "TOKEN_BEARING_URL")),
        ("https://x.org/\\a", (None, "INVALID_URL")), ("https://bücher.de/ä", ("https://xn--bcher-kva.de/ä", None)),
    ],
)
def test_canonical_url(spark, given, wanted):
    assert tuple(one(spark, urls.canonical_url(lit(given)))) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("https://jobs.example.org/1", None), ("http://127.0.0.1/", "PRIVATE_ADDRESS"), ("http://[::ffff:10.0.0.1]/", "PRIVATE_ADDRESS"), ("https://www.linkedin.com/x", "RESTRICTED_PLATFORM_MANUAL_ONLY"), ("http://a.internal/", "PRIVATE_HOST"), ("http://8.8.8.8/", None)],
)
def test_refusal(given, wanted):
    assert urls.refusal(given) == wanted


def test_uid_keeps_nulls_apart(spark):
    a, b = (one(spark, hashing.uid(*c)) for c in ((lit("x"), lit(None), lit("y")), (lit("x"), lit("y"), lit(None))))
    assert a != b and len(a) == 64


def test_token(spark):
    key = b"k" * 40
    assert hashing.token(key, "email", " A@B.org ") == hashing.token(key, "email", "a@b.org") != hashing.token(key, "name", "a@b.org")
    assert hashing.token(key, "phone", "+49 (170) 123-4567") == hashing.token(key, "phone", "+491701234567")
    for kind, value, size in (("phone", "0170", 40), ("email", "x", 8), ("Bad Kind", "x", 40)):
        with pytest.raises(ValueError):
            hashing.token(b"k" * size, kind, value)
    assert one(spark, hashing.private_token("email", lit("a@b.org"))) == hashing.token(key, "email", "a@b.org")


@pytest.mark.parametrize(
    ("age", "band"),
    [(0.0, "HOT_0_6H"), (5.99, "HOT_0_6H"), (6.0, "EARLY_6_24H"), (24.0, "FRESH_1_3D"), (95.9, "FRESH_1_3D"), (96.0, "OPEN_4_7D"), (192.0, "AGING_8_14D"), (360.0, "STALE_15D_PLUS"), (None, "BASELINE_DATE_UNKNOWN"), (-1.0, None)],
)
def test_bands(spark, age, band):
    assert one(spark, dates.freshness_band(lit(age, "double"), F.lit(True))) == band


@pytest.mark.parametrize(
    ("given", "zone", "confidence", "low", "high", "error"),
    [
        ("2 hours ago", "UTC", "RELATIVE_PARSED", 2.0, 3.0, ""), ("1 day ago", "UTC", "RELATIVE_PARSED", 24.0, 48.0, ""), ("2026-08-15", "UTC", "DATE_ONLY", 0.0, 8.0, ""), ("today", "Asia/Kolkata", "DATE_ONLY", 0.0, 13.5, ""), ("yesterday", "UTC", "DATE_ONLY", 8.0, 32.0, ""),
        ("2026-08-15T06:00:00+00:00", "UTC", "EXACT", 2.0, 2.0, ""), ("2026-08-15T06:00:00Z", "UTC", "EXACT", 2.0, 2.0, ""), ("Sat, 15 Aug 2026 06:00:00 GMT", "UTC", "EXACT", 2.0, 2.0, ""), ("2026-08-15T06:00:00", "UTC", "MISSING", None, None, "NAIVE_POSTED_DATE"),
        ("soon", "UTC", "MISSING", None, None, "INVALID_POSTED_DATE"), ("2026-08-16T06:00:00Z", "UTC", "MISSING", None, None, "FUTURE_POSTED_DATE"), (None, "UTC", "MISSING", None, None, ""), ("2026-13-40", "UTC", "MISSING", None, None, "INVALID_POSTED_DATE"),
    ],
)
def test_posted_date(spark, given, zone, confidence, low, high, error):
    now = lit("2026-08-15 08:00:00", "timestamp")
    found = one(spark, dates.posted_date(lit(given), now, F.lit(zone)))
    assert (found["confidence"], found["age_min"], found["age_max"], found["error"]) == (confidence, low, high, error)


def test_local_day_of_daylight_saving(spark):
    found = one(spark, dates.posted_date(lit("2026-03-29"), lit("2026-04-10 00:00:00", "timestamp"), F.lit("Europe/Berlin")))
    assert found["age_max"] - found["age_min"] == 23.0


def test_due_now(spark):
    now = lit("2026-08-15 08:00:00", "timestamp")
    due = lambda x: one(spark, dates.due_now(lit(x), now))
    assert [due(x) for x in ("2026-08-15T08:00:00Z", "2026-08-15 13:30 IST", "2026-08-15 13:31 IST", "2026-08-15T01:00:00", "x", None)] == [True, True, False, False, False, False]


def test_business_days_and_windows(spark):
    assert str(one(spark, dates.business_days_after(lit("2026-08-14", "date")))) == "2026-08-21"
    assert str(one(spark, dates.digest_window(lit("2026-08-15 08:00:00", "timestamp"), F.lit(False)))) == "2026-08-15 02:41:00"
    assert str(one(spark, dates.month_last(lit("2024-02")))) == "2024-02-29 23:59:59"


def test_tenure(spark):
    now = lit("2026-06-01 00:00:00", "timestamp")
    plain = one(spark, dates.tenure_years(now, lit("2024-06"), lit(None), lit(None), F.lit(False)))
    more = one(spark, dates.tenure_years(now, lit("2024-06"), lit("2024-01"), lit("2024-05"), F.lit(True)))
    assert 1.9 < plain["low"] < plain["high"] < 2.0 and more["low"] > plain["low"] and more["high"] > plain["high"]
