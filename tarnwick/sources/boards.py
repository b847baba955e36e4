"""JSON board payloads to raw rows (SRC-01 to SRC-03, SRC-10, SRC-11): from_json, explode, and per-payload checks.

payloads: source_id, provider, tenant, company, url, fetched_at, content. Every
parser returns raw rows and, apart from them, one error row per payload that fails;
a failed payload gives no rows. Of equal ids the last row counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick import scratch
from tarnwick.functions.dates import instant
from tarnwick.functions.hashing import digest

RAW = ("source_id", "provider", "tenant", "provider_job_id", "title", "company", "location", "description", "url", "apply_url", "fetched_at", "posted_at_raw", "updated_at_raw", "deadline_raw", "salary_text", "official_link_state")
_GREENHOUSE = "id: string, title: string, location: struct<name: string>, absolute_url: string, first_published: string, updated_at: string, application_deadline: string, content: string, pay_input_ranges: array<variant>"
_LEVER = "id: string, text: string, categories: struct<location: string>, descriptionPlain: string, description: string, lists: array<struct<text: string, content: string>>, hostedUrl: string, applyUrl: string, salaryRange: variant"
_ASHBY = "title: string, isListed: variant, location: string, descriptionPlain: string, descriptionHtml: string, publishedAt: string, jobUrl: string, applyUrl: string, compensation: struct<scrapeableCompensationSalarySummary: string>"


@dataclass(frozen=True)
class Parsed:
    rows: DataFrame
    errors: DataFrame  # source_id, url, error


def _filled(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _finish(read: DataFrame, array: str, error: Column, fields: dict[str, Column], keep: Column | None = None) -> Parsed:
    """Explode the records of good payloads and reject payloads with a bad row or an id of two contents."""
    payload = read.withColumn("__error", error)
    rows = payload.where("__error is null").select("*", F.posexplode(array).alias("__pos", "r"))
    rows = rows if keep is None else rows.where(keep)
    made = rows.select("__payload", "__pos", F.sha2(F.to_json("r"), 256).alias("__digest"), "source_id", "provider", "tenant", F.col("url").alias("__page"), "fetched_at", *[v.alias(k) for k, v in fields.items()])
    by_id = Window.partitionBy("__payload", "provider_job_id")
    checked = made.withColumns({"__kinds": F.size(F.collect_set("__digest").over(by_id)), "__last": F.row_number().over(by_id.orderBy(F.desc("__pos")))})
    row_error = F.when(F.coalesce(_filled(F.col("provider_job_id")), F.lit("")) == "", "MISSING_ID").when(F.coalesce(_filled(F.col("title")), F.lit("")) == "", "MISSING_TITLE").when((F.col("__kinds") > 1) & F.col("provider").isin("greenhouse", "google_careers"), "CONFLICTING_JOB_ID")
    marked = checked.withColumn("__row_error", row_error)
    bad = marked.groupBy("__payload").agg(F.min("__row_error").alias("error"), F.countDistinct("provider_job_id").alias("unique")).join(payload.select("__payload", "source_id", "url", *[c for c in ("__total",) if c in payload.columns]), "__payload")
    if "__total" in payload.columns:
        bad = bad.withColumn("error", F.coalesce("error", F.when(F.col("__total").isNotNull() & (F.col("__total") != F.col("unique")), "TOTAL_MISMATCH")))
    failed = bad.where("error is not null").select("__payload", "source_id", "url", "error").unionByName(payload.where("__error is not null").select("__payload", "source_id", "url", F.col("__error").alias("error")))
    good = marked.where("__last = 1").join(failed.select("__payload"), "__payload", "left_anti")
    empty = F.lit("")
    rows = good.select(*[F.col(c) if c in good.columns else F.lit("VERIFIED_OFFICIAL").alias(c) if c == "official_link_state" else empty.alias(c) for c in RAW])
    return Parsed(rows, failed.drop("__payload"))


def _kept(payloads: DataFrame) -> DataFrame:
    """payloads with a number each, written once: rows and errors meet again by it."""
    if "__payload" in payloads.columns:
        return payloads
    return scratch.table(payloads.sparkSession, payloads.withColumn("__payload", F.monotonically_increasing_id()), "payloads")


def parse_greenhouse(payloads: DataFrame) -> Parsed:
    """SRC-01: an object with jobs[] or one detail object; meta.total must equal the number of ids."""
    v = F.try_parse_json("content")
    one = F.from_json("content", f"struct<{_GREENHOUSE}>")
    many = F.from_json("content", f"struct<jobs: array<struct<{_GREENHOUSE}>>, meta: struct<total: bigint>>")
    read = _kept(payloads).withColumns({"__many": many, "__one": one, "__kind": F.schema_of_variant(F.try_variant_get(v, "$.jobs", "variant"))})
    listed = F.startswith(F.coalesce("__kind", F.lit("")), F.lit("ARRAY"))
    read = read.withColumns({"__jobs": F.when(listed, F.col("__many.jobs")).when(F.col("__one.id").isNotNull(), F.array("__one")), "__total": F.when(listed, F.col("__many.meta.total"))})
    error = F.when(v.isNull(), "MALFORMED_JSON").when(F.col("__jobs").isNull(), "MISSING_JOBS_ARRAY")
    r = F.col("r")
    return _finish(read, "__jobs", error, {
        "provider_job_id": r["id"], "title": r["title"], "company": F.col("company"), "location": F.coalesce(r["location"]["name"], F.lit("")), "description": F.coalesce(r["content"], F.lit("")), "url": r["absolute_url"],
        "apply_url": F.lit(""), "posted_at_raw": r["first_published"], "updated_at_raw": r["updated_at"], "deadline_raw": r["application_deadline"], "salary_text": F.when(F.size(r["pay_input_ranges"]) > 0, F.to_json(r["pay_input_ranges"])).otherwise(""),
    })


def parse_lever(payloads: DataFrame) -> Parsed:
    """SRC-02: an array of postings; sections are appended to the description, createdAt is not a date of posting."""
    kind = F.schema_of_variant(F.try_parse_json("content"))
    read = _kept(payloads).withColumn("__jobs", F.from_json("content", f"array<struct<{_LEVER}>>"))
    error = F.when(F.try_parse_json("content").isNull(), "MALFORMED_JSON").when(~F.startswith(kind, F.lit("ARRAY")), "EXPECTED_POSTINGS_ARRAY")
    r, blank = F.col("r"), lambda x: F.coalesce(x, F.lit(""))
    sections = F.transform(F.coalesce(r["lists"], F.array().cast("array<struct<text: string, content: string>>")), lambda s: F.concat(F.lit(" "), blank(s["text"]), F.lit(" "), blank(s["content"])))
    return _finish(read, "__jobs", error, {
        "provider_job_id": r["id"], "title": r["text"], "company": F.col("company"), "location": blank(r["categories"]["location"]), "description": F.concat(F.coalesce(_filled(r["descriptionPlain"]), r["description"], F.lit("")), F.array_join(sections, "")),
        "url": r["hostedUrl"], "apply_url": blank(r["applyUrl"]), "salary_text": blank(F.to_json(r["salaryRange"])),
    })


def parse_ashby(payloads: DataFrame) -> Parsed:
    """SRC-03: listed rows only; a row without a boolean isListed fails the payload."""
    v = F.try_parse_json("content")
    read = _kept(payloads).withColumns({"__jobs": F.from_json("content", f"struct<jobs: array<struct<{_ASHBY}>>>")["jobs"], "__kind": F.schema_of_variant(F.try_variant_get(v, "$.jobs", "variant"))})
    flagged = F.forall("__jobs", lambda j: F.coalesce(F.schema_of_variant(j["isListed"]) == "BOOLEAN", F.lit(False)))
    error = F.when(v.isNull(), "MALFORMED_JSON").when(~F.startswith(F.coalesce("__kind", F.lit("")), F.lit("ARRAY")), "MISSING_JOBS_ARRAY").when(~flagged, "MISSING_LISTED_FLAG")
    r, blank = F.col("r"), lambda x: F.coalesce(x, F.lit(""))
    listed = F.try_variant_get(r["isListed"], "$", "boolean")
    return _finish(read, "__jobs", error, {
        "provider_job_id": r["jobUrl"], "title": r["title"], "company": F.col("company"), "location": blank(r["location"]), "description": F.coalesce(_filled(r["descriptionPlain"]), r["descriptionHtml"], F.lit("")), "url": r["jobUrl"],
        "apply_url": blank(r["applyUrl"]), "posted_at_raw": r["publishedAt"], "salary_text": blank(r["compensation"]["scrapeableCompensationSalarySummary"]),
    }, keep=listed)


def parse(payloads: DataFrame, mail_key: bytes = b"", senders: frozenset[str] = frozenset()) -> Parsed:
    """SRC-10: each provider's payloads through its parser; an unknown provider is an error.

    Payloads are written once, by provider, so that each parser scans its own ones only.
    """
    from tarnwick.sources.markup import parse_marked

    numbered = payloads.withColumns({"__payload": F.monotonically_increasing_id(), "__provider": F.coalesce("provider", F.lit(""))})
    held = scratch.table(payloads.sparkSession, numbered, "payloads", ["__provider"])
    boards = {"greenhouse": parse_greenhouse, "lever": parse_lever, "ashby": parse_ashby}
    marked = ("feed", "jsonld", "google_careers", "manual", "email")
    found = [parser(held.where(F.col("__provider") == provider)) for provider, parser in boards.items()]
    found.append(parse_marked(held.where(F.col("__provider").isin(*marked)), marked, mail_key, senders))
    rows, errors = found[0].rows, found[0].errors
    for one in found[1:]:
        rows, errors = rows.unionByName(one.rows), errors.unionByName(one.errors)
    other = held.where(~F.coalesce(F.col("__provider").isin(*boards, *marked), F.lit(False))).select("source_id", "url", F.lit("UNKNOWN_PROVIDER").alias("error"))
    return Parsed(rows, errors.unionByName(other))


def listing_version(parser_version: str) -> Column:
    """HSH-06: digest of a raw row's listing fields; rows without an update time with an offset raise."""
    updated = instant(F.col("updated_at_raw"))
    known = F.when(updated.isNull(), F.raise_error(F.lit("LISTING_VERSION_REQUIRED")).cast("long")).otherwise(F.unix_micros(updated))
    fields = {n: F.coalesce(n, F.lit("")) for n in ("provider_job_id", "tenant", "company", "title", "location", "url")}
    return digest(**fields, updated=known, parser=F.lit(parser_version))
