"""Payload parsers: success, empty, duplicate, conflict, schema and limits."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnwick.sources import boards, files, markup

COLUMNS = "source_id string, provider string, tenant string, company string, url string, fetched_at string, content string"


PAGES = {"google_careers": "https://www.google.com/about/careers/applications/jobs/results/?q=x"}


def payloads(spark, *rows):
    return spark.createDataFrame([(f"s{n}", provider, "t", "Acme", PAGES.get(provider, "https://x.org/jobs"), "2026-08-15 00:00:00", content) for n, (provider, content) in enumerate(rows)], COLUMNS).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


def run(spark, *rows):
    found = boards.parse(payloads(spark, *rows))
    return [r.asDict() for r in found.rows.orderBy("source_id", "provider_job_id").collect()], {r["source_id"]: r["error"] for r in found.errors.collect()}


JOB = {"id": 1, "title": "Engineer", "location": {"name": "Pune"}, "absolute_url": "https://x.org/1", "content": "<p>text</p>", "first_published": "2026-08-01"}


def test_greenhouse(spark):
    other = JOB | {"id": 2, "pay_input_ranges": [{"min_cents": 1}]}
    rows, errors = run(
        spark, ("greenhouse", json.dumps({"jobs": [JOB, other], "meta": {"total": 2}})), ("greenhouse", json.dumps(JOB)), ("greenhouse", json.dumps({"jobs": []})), ("greenhouse", json.dumps({"jobs": [JOB, JOB]})),
        ("greenhouse", json.dumps({"jobs": [JOB, JOB | {"title": "Other"}]})), ("greenhouse", json.dumps({"jobs": [JOB], "meta": {"total": 3}})), ("greenhouse", "{}"), ("greenhouse", "no"), ("greenhouse", json.dumps({"jobs": [{"id": 5}]})),
    )
    assert [(r["source_id"], r["provider_job_id"]) for r in rows] == [("s0", "1"), ("s0", "2"), ("s1", "1"), ("s3", "1")]
    assert rows[0]["location"] == "Pune" and rows[0]["posted_at_raw"] == "2026-08-01" and json.loads(rows[1]["salary_text"]) == [{"min_cents": 1}]
    assert errors == {"s4": "CONFLICTING_JOB_ID", "s5": "TOTAL_MISMATCH", "s6": "MISSING_JOBS_ARRAY", "s7": "MALFORMED_JSON", "s8": "MISSING_TITLE"}


def test_lever(spark):
    job = {"id": "a", "text": "Engineer", "categories": {"location": "Pune"}, "descriptionPlain": "Do", "lists": [{"text": "Must", "content": "Java"}], "hostedUrl": "https://x.org/a", "createdAt": 1}
    rows, errors = run(spark, ("lever", json.dumps([job, job | {"id": "b", "text": "Last"}, job | {"id": "b"}])), ("lever", "[]"), ("lever", "{}"))
    assert [(r["provider_job_id"], r["title"], r["description"], r["posted_at_raw"]) for r in rows] == [("a", "Engineer", "Do Must Java", ""), ("b", "Engineer", "Do Must Java", "")]
    assert errors == {"s2": "EXPECTED_POSTINGS_ARRAY"}


def test_ashby(spark):
    job = {"title": "Engineer", "isListed": True, "jobUrl": "https://x.org/a", "publishedAt": "2026-08-01", "compensation": {"scrapeableCompensationSalarySummary": "1"}}
    rows, errors = run(spark, ("ashby", json.dumps({"jobs": [job, job | {"isListed": False, "jobUrl": "https://x.org/b"}]})), ("ashby", json.dumps({"jobs": [job | {"isListed": "yes"}]})), ("ashby", "[]"))
    assert [(r["provider_job_id"], r["salary_text"]) for r in rows] == [("https://x.org/a", "1")]
    assert errors == {"s1": "MISSING_LISTED_FLAG", "s2": "MISSING_JOBS_ARRAY"}


RSS = "<rss><channel><item><guid>g</guid><title>Engineer</title><link>https://x.org/g</link><description>d</description><pubDate>Sat, 15 Aug 2026 06:00:00 GMT</pubDate></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title>Engineer</title><link rel="self" href="https://x.org/self"/><link href="https://x.org/i"/><summary>s</summary><published>2026-08-01T00:00:00Z</published></entry></feed>'


def test_feeds(spark):
    rows, errors = run(spark, ("feed", RSS), ("feed", ATOM), ("feed", "<x/>"), ("feed", '<!DOCTYPE x [<!ENTITY a "b">]><rss/>'), ("feed", "<rss>"), ("unknown", ""))
    assert [(r["provider_job_id"], r["url"], r["description"]) for r in rows] == [("g", "https://x.org/g", "d"), ("i", "https://x.org/i", "s")]
    assert errors == {"s2": "UNKNOWN_FEED_ROOT", "s3": "XML_FORBIDDEN_CONSTRUCT", "s4": "XML_MALFORMED", "s5": "UNKNOWN_PROVIDER"}


def test_jsonld(spark):
    place = {"address": {"addressLocality": "Pune", "addressCountry": "IN"}}
    one = {"@type": ["JobPosting", "x"], "identifier": {"value": 7}, "title": "A", "hiringOrganization": {"name": "Org"}, "jobLocation": [place, {"address": {"addressRegion": "MH"}}], "url": "https://x.org/7"}
    page = f'<p></p><script type="application/ld+json">{json.dumps({"@graph": [one, {"@type": "Thing"}]})}</script><script>var a;</script>'
    rows, errors = run(spark, ("jsonld", page), ("jsonld", "<p>none</p>"), ("jsonld", '<script type="application/ld+json">{"@graph": 1}</script>'), ("jsonld", '<script type="application/ld+json">{</script>'))
    assert [(r["provider_job_id"], r["company"], r["location"]) for r in rows] == [("7", "Org", "Pune, IN; MH")]
    assert errors == {"s2": "INVALID_GRAPH", "s3": "MALFORMED_JSON"}


def card(n, label="Learn more about Role {n}"):
    return f'<li><div><h3>Role {n}</h3><span class="r0wTof">Pune</span><span class="r0wTof">Delhi</span><div class="Xsxa1e">Java <b>work</b></div><a aria-label="{label.format(n=n)}" href="jobs/results/{n}-role?q=1">go</a></div></li>'


def test_cards(spark):
    rows, errors = run(spark, ("google_careers", "<p>2 jobs matched</p>" + card(1) + card(2)), ("google_careers", "<p>3 jobs matched</p>" + card(1)), ("google_careers", card(1)), ("google_careers", "<p>1 job matched</p>" + card(1, "Learn more about X")))
    assert [(r["provider_job_id"], r["title"], r["location"], r["description"]) for r in rows] == [("1", "Role 1", "Pune; Delhi", "Java work"), ("2", "Role 2", "Pune; Delhi", "Java work")]
    assert errors == {"s1": "VISIBLE_PAGE_INCOMPLETE", "s2": "RESULT_COUNT_MISSING", "s3": "TITLE_MISMATCH"}


def test_sitemap():
    urls = "".join(f"<url><loc>https://x.org/{p}</loc></url>" for p in "baa")
    assert markup.sitemap_urls(f"<urlset>{urls}</urlset>", "https://x.org/") == ["https://x.org/a", "https://x.org/b"]
    for text in ("<sitemapindex/>", "<urlset><url><loc>https://y.org/</loc></url></urlset>", "<urlset><url><loc>ftp://x.org/</loc></url></urlset>"):
        with pytest.raises(markup.Rejected):
            markup.sitemap_urls(text, "https://x.org/")


def test_sitemaps_as_tables(spark):
    page = lambda *urls: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    rows = [("a", "https://x.org/s", page("https://x.org/2", "https://x.org/1", "https://x.org/2")), ("b", "https://x.org/s", page("https://y.org/")), ("c", "https://x.org/s", None), ("d", "https://x.org/s", page())]
    found, errors = markup.parse_sitemaps(spark.createDataFrame(rows, "source_id string, url string, content string"))
    assert sorted((r["source_id"], r["url"]) for r in found.collect()) == [("a", "https://x.org/1"), ("a", "https://x.org/2")]
    assert {r["source_id"]: r["error"] for r in errors.collect()} == {"b": "SITEMAP_CROSS_ORIGIN", "c": "XML_MALFORMED"}


def test_all_providers_in_one_call(spark):
    mail = 'From: Alerts <a@x.org>\r\nContent-Type: text/html\r\n\r\n<a href="https://x.org/1">Role <b>one</b></a><a href="https://x.org/3">open<a href="https://x.org/4">next</a>'
    rows = [
        ("g", "greenhouse", '{"jobs": [{"id": 1, "title": "T"}]}'), ("m", "email", mail), ("n", "email", mail.replace("a@x.org>", "b@x.org>")), ("i", "manual", "id,title,company\n7,Role,\"A, B\"\n"), ("j", "manual", '[{"id": 8, "title": "Role", "url": "https://x.org"}]'), ("k", "manual", "[1]"),
        ("f", "feed", "<rss><channel><item><guid>9</guid><title>F</title></item></channel></rss>"), ("z", "else", "x"), ("y", None, "x"),
    ]
    payloads = spark.createDataFrame([(s, p, "t", "Acme", "https://x.org/page", datetime(2026, 8, 15), c) for s, p, c in rows], "source_id string, provider string, tenant string, company string, url string, fetched_at timestamp, content string")
    found = boards.parse(payloads, b"k" * 40, frozenset({"a@x.org"}))
    assert sorted((r["source_id"], r["provider_job_id"], r["title"], r["company"], r["official_link_state"][:8]) for r in found.rows.collect()) == [
        ("f", "9", "F", "Acme", "VERIFIED"), ("g", "1", "T", "Acme", "VERIFIED"), ("i", "7", "Role", "A, B", "OFFICIAL"), ("j", "8", "Role", "Acme", "OFFICIAL"), ("m", "https://x.org/1", "Role one", "Acme", "OFFICIAL"), ("m", "https://x.org/4", "next", "Acme", "OFFICIAL"),
    ]
    assert {r["source_id"]: r["error"] for r in found.errors.collect()} == {"n": "SENDER_NOT_ALLOWLISTED", "k": "EXPECTED_OBJECT", "z": "UNKNOWN_PROVIDER", "y": "UNKNOWN_PROVIDER"}


@pytest.mark.parametrize(
    ("url", "link", "error"),
    [
        ("https://evil.example/about/careers/applications/jobs/results", "jobs/results/1-x", "FIRST_PAGE_ONLY"), ("http://www.google.com/about/careers/applications/jobs/results", "jobs/results/1-x", "FIRST_PAGE_ONLY"), ("https://www.google.com/about/careers/applications/jobs/results?page=2", "jobs/results/1-x", "FIRST_PAGE_ONLY"),
        ("https://www.google.com/about/careers/applications/jobs/results/", "http://evil.example/about/careers/applications/jobs/results/1-x", "CARD_LINK_INVALID"), ("https://www.google.com/about/careers/applications/jobs/results/", "http://www.google.com/about/careers/applications/jobs/results/1-x", "CARD_LINK_INVALID"),
        ("https://www.google.com/about/careers/applications/jobs/results/", "jobs/results/1", "CARD_LINK_INVALID"), ("https://www.google.com/about/careers/applications/jobs/results/?q=x", "jobs/results/1-x?q=x", None),
    ],
)
def test_cards_of_one_site_only(url, link, error):
    page = f'<p>1 job matched</p><h3>Role</h3><span class="r0wTof">Pune</span><div class="Xsxa1e">Java</div><a aria-label="Learn more about Role" href="{link}">go</a>'
    if error is None:
        assert [r["provider_job_id"] for r in markup.card_rows(page, url)] == ["1"]
    else:
        with pytest.raises(markup.Rejected, match=error):
            list(markup.card_rows(page, url))


def test_xml_limits():
    assert markup.safe_xml("<a>" * 64 + "</a>" * 64) is not None
    for text in ("<a>" * 65 + "</a>" * 65, "<a " + " ".join(f'x{n}="1"' for n in range(101)) + "/>"):
        with pytest.raises(markup.Rejected, match="XML_STRUCTURE_LIMIT"):
            markup.safe_xml(text)


def test_mail():
    message = b'From: Alerts <a@x.org>\r\nContent-Type: text/html\r\n\r\n<a href="https://x.org/1">Role</a><a href="https://x.org/?token=1">Bad</a><a href="https://x.org/2"> </a>'
    token, rows = markup.mail_rows(message, "Acme", b"k" * 40, frozenset({"a@x.org"}))
    assert len(token) == 64 and [r["title"] for r in rows] == ["Role"]
    with pytest.raises(markup.Rejected, match="SENDER_NOT_ALLOWLISTED"):
        markup.mail_rows(message, "Acme", b"k" * 40, frozenset({"b@x.org"}))


@pytest.mark.parametrize(("kind", "content"), [("csv", "﻿title,id,company\nRole,1,\"A, B\"\n"), ("tsv", "title\tid\tcompany\nRole\t1\tA, B\n"), ("json", '[{"title": "Role", "id": "1", "company": "A, B"}]')])
def test_imports(spark, tmp_path, kind, content):
    path = tmp_path / f"jobs.{kind}"
    path.write_text(content, encoding="utf-8")
    row = files.read_import(spark, str(path), kind).first()
    assert (row["id"], row["title"], row["company"], row["url"]) == ("1", "Role", "A, B", None)
    with pytest.raises(ValueError):
        files.read_import(spark, str(path), "xlsx")


def test_contacts(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('Notes:\n"some text"\n\nFirst Name,Last Name,URL,Email Address,Company,Position\nAda,L,https://www.linkedin.com/in/ada,ADA@X.org,Acme,Dev\nBob,,http://bad,not-mail,"B, C",\n', encoding="utf-8")
    rows = files.read_contacts(spark, str(path), "linkedin-connections").orderBy("name").collect()
    assert [(r["name"], r["work_email"], r["linkedin_url"], r["company"]) for r in rows] == [("Ada L", "ada@x.org", "https://www.linkedin.com/in/ada", "Acme"), ("Bob", "", "", "B, C")]
    assert {r["relationship_basis"] for r in rows} == {"FIRST_DEGREE_IMPORTED"}


def test_catalogue(spark):
    assert files.catalogue(spark, [{"source_id": "a", "tier": "1"}, {"source_id": "b"}]).count() == 2
    with pytest.raises(ValueError):
        files.catalogue(spark, [{"source_id": "a"}, {"source_id": "a"}])


@pytest.mark.parametrize(
    ("status", "kind", "body", "wanted"),
    [
        (304, "", "", "NO_CHANGE"), (403, "", "", "POLICY_BLOCKED"), (429, "", "", "BACKOFF"), (503, "", "", "FAILED_TRANSIENT"), (404, "", "", "FAILED_PERMANENT"), (200, "text/html", "", "QUARANTINED_SCHEMA"), (200, "application/json", "x g-recaptcha", "POLICY_BLOCKED"),
        (200, "application/json", "Sign in to continue", "LOGIN_REQUIRED"), (200, "application/json; charset=utf-8", "{}", "SUCCESS_COMPLETE"),
    ],
)
def test_outcomes(spark, status, kind, body, wanted):
    found = files.response_outcome(F.lit(status), F.lit(kind), F.lit(len(body)), F.lit(body), F.lit("json"))
    assert spark.range(1).select(found.alias("x")).first()["x"]["outcome"] == wanted


def test_retry_seconds(spark):
    now = F.lit("2026-08-15 06:00:00").cast("timestamp")
    read = lambda x: spark.range(1).select(files.retry_seconds(F.lit(x), now).alias("x")).first()["x"]
    assert [read(x) for x in ("30", "Sat, 15 Aug 2026 06:01:00 GMT", "soon")] == [30, 60, None]
