"""User files: record imports, contact exports, a source catalogue, and responses (SRC-07, SRC-12, SRC-13, SRC-18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMPORT = "id string, company string, title string, url string, apply_url string, location string, description string, posted_at string"

# Header names of the export formats, by field.
ALIASES: dict[str, tuple[str, ...]] = {
    "first": ("first name", "given name", "firstname"), "last": ("last name", "family name", "lastname"), "name": ("name", "full name"),
    "company": ("company", "organization 1 - name", "organization name", "current company"), "title": ("position", "title", "organization 1 - title", "job title"),
    "email": ("email address", "e-mail 1 - value", "email", "work email"), "linkedin": ("url", "linkedin url", "linkedin"), "phone": ("phone", "phone 1 - value", "phone number"),
    "relationship": ("relationship basis", "relationship"),
}
ORIGINS = {"linkedin-connections": "LINKEDIN_CONNECTIONS_EXPORT", "google-contacts": "GOOGLE_CONTACTS_EXPORT", "csv": "USER_CSV", "generic": "USER_CSV"}


def read_import(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """SRC-07: JSON array, CSV or TSV with a header; columns are matched by name, a malformed file fails."""
    if kind == "json":
        return spark.read.schema(IMPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if kind not in ("csv", "tsv"):
        raise ValueError("UNSUPPORTED_IMPORT_FORMAT")
    separator = "\t" if kind == "tsv" else ","
    found = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in found.columns}
    wanted = [part.split()[0] for part in IMPORT.split(", ")]
    return found.select(*[F.col(f"`{names[c]}`").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in wanted])


def read_contacts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """SRC-13: the header is the first line with a known name; fields come from the first alias that is filled.

    Invalid e-mail addresses, profile links and phone numbers become blank.
    """
    if kind not in ORIGINS:
        raise ValueError("UNSUPPORTED_CONTACTS_FORMAT")
    known = {a for names in ALIASES.values() for a in names}
    lines = spark.read.text(path).select(F.lower(F.regexp_replace("value", "[﻿\"]", "")).alias("v"), F.col("value"))
    header = lines.where(F.size(F.array_intersect(F.transform(F.split("v", ","), lambda x: F.trim(x)), F.array(*map(F.lit, sorted(known))))) >= 2).first()
    if header is None:
        raise ValueError("CONTACT_HEADER_MISSING")
    names = [n.strip() for n in header["v"].split(",")]
    rows = spark.read.option("multiLine", True).option("escape", '"').schema(", ".join(f"c{n} string" for n in range(len(names)))).csv(path)
    own = [F.lower(F.trim(F.regexp_replace(f"c{n}", "[﻿\"]", ""))) for n in range(len(names))]
    # Lines before the header have fewer cells than it; the header itself is recognised by its names.
    is_header = reduce(lambda a, b: a & b, [F.coalesce(o, F.lit("")) == name for o, name in zip(own, names, strict=True)])
    preamble = reduce(lambda a, b: a & b, [F.col(f"c{n}").isNull() for n in range(1, len(names))]) if len(names) > 1 else F.lit(False)
    body = rows.where(~is_header & ~preamble)

    def field(name: str) -> Column:
        filled = [F.nullif(F.trim(f"c{names.index(a)}"), F.lit("")) for a in ALIASES[name] if a in names]
        return F.coalesce(*filled, F.lit(""))

    email, link, phone = F.lower(field("email")), field("linkedin"), F.regexp_replace(field("phone"), "[ ()-]", "")
    full = F.coalesce(F.nullif(field("name"), F.lit("")), F.trim(F.concat_ws(" ", field("first"), field("last"))))
    return body.select(
        full.alias("name"), field("company").alias("company"), field("title").alias("title"), F.when(email.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"), email).otherwise("").alias("work_email"),
        F.when(link.rlike(r"^https://([a-z]+\.)?linkedin\.com/in/[^/?#\s]+"), link).otherwise("").alias("linkedin_url"), F.when(phone.rlike(r"^\+[1-9]\d{7,14}$"), phone).otherwise("").alias("phone"),
        F.coalesce(F.nullif(field("relationship"), F.lit("")), F.lit("FIRST_DEGREE_IMPORTED" if kind == "linkedin-connections" else "UNKNOWN")).alias("relationship_basis"), F.lit(ORIGINS[kind]).alias("contact_origin"),
    ).where("name <> '' or work_email <> '' or linkedin_url <> ''")


def catalogue(spark: SparkSession, entries: list[dict[str, str]], key: str = "source_id") -> DataFrame:
    """SRC-12: a small catalogue with unique keys as a dimension."""
    keys = [e[key] for e in entries]
    if len(set(keys)) != len(keys):
        raise ValueError("DUPLICATE_CATALOGUE_KEY")
    names = sorted({k for e in entries for k in e})
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], ", ".join(f"{n} string" for n in names))


def response_outcome(status: Column, content_type: Column, size: Column, body: Column, expected: Column, most_bytes: int = 5 << 20) -> Column:
    """SRC-18: struct(outcome, error_code) of a recorded response; the first rule that holds."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 100_000))
    both = lambda a, b: F.struct(F.lit(a).alias("outcome"), F.lit(b).alias("error_code"))
    return (
        F.when(status == 304, both("NO_CHANGE", ""))
        .when(status.isin(401, 403), both("POLICY_BLOCKED", "ACCESS_DENIED"))
        .when(status == 429, both("BACKOFF", "RATE_LIMIT"))
        .when(status.isin(408, 425, 500, 502, 503, 504), both("FAILED_TRANSIENT", "RETRY_EXHAUSTED"))
        .when(status.isin(301, 302, 303, 307, 308), both("FAILED_PERMANENT", "REDIRECT_LIMIT_OR_PROBE_REDIRECT"))
        .when(status != 200, both("FAILED_PERMANENT", "HTTP_ERROR"))
        .when(~F.contains(F.lower(F.coalesce(content_type, F.lit(""))), expected), both("QUARANTINED_SCHEMA", "CONTENT_TYPE"))
        .when(size > most_bytes, both("QUARANTINED_SCHEMA", "RESPONSE_TOO_LARGE"))
        .when(head.rlike("g-recaptcha|h-captcha|cf-chl-|verify you are human"), both("POLICY_BLOCKED", "CAPTCHA_STOP"))
        .when(F.contains(head, F.lit('<input type="password"')) | F.contains(head, F.lit("sign in to continue")), both("LOGIN_REQUIRED", "LOGIN_STOP"))
        .otherwise(both("SUCCESS_COMPLETE", ""))
    )


def retry_seconds(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, given as a number or a date; null if neither."""
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(header, r"^[A-Za-z]{3}, ", ""), "GMT$", "+0000"), F.lit("dd MMM yyyy HH:mm:ss Z"))
    return F.when(header.rlike(r"^\d{1,9}$"), header.try_cast("long")).when(date.isNotNull(), F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", now, date)))
