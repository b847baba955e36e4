"""Bronze records to silver records (NRM-*, SRC-11, PRD-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import dates, hashing, text, urls

# Patterns over the normalized title, in order of precedence.
FAMILIES = (
    ("BACKEND", r"backend|back end|java|spring boot|api engineer"),
    ("PLATFORM", r"platform|infrastructure|cloud engineer|developer infrastructure"),
    ("RELIABILITY", r"site reliability|production engineer|\bsre\b|reliability"),
    ("FULL_STACK", r"full stack|fullstack"),
    ("DISTRIBUTED_SYSTEMS", r"distributed systems|search|ranking|recommendation|personalization"),
    ("SOFTWARE", r"software|\bsde\b|\bswe\b|\bmts\b|member of technical staff|application developer"),
)
SENIOR_TITLE = r"\b(senior|sr|staff|lead|principal|architect|manager|director|head)\b"
SENIOR_SCOPE = r"(?i)(?:manage|lead) (?:a |the )?(?:team of|engineering team)|staff.level scope"
OTHER_FIELD = r"frontend|front end|mobile|android|ios|manual qa|tech support|sales|product manager"
BUILDS_CODE = r"(?i)develop|software|programming|code|backend|back.end|java|python|build.*(?:api|service)"
OPTIONAL = r"(?i)preferred|nice.to.have|desirable|bonus"
HOME = r"(?i)india|bengaluru|bangalore|hyderabad|pune|chennai|mumbai|noida|gurugram|gurgaon|delhi"
ELSEWHERE = r"(?:us|usa|united states|europe|uk) (?:only|residents)|must (?:reside|be based) in (?:us|usa|europe|uk)"
WELCOMES = r"(?i)india.based candidates|relocation (?:provided|supported)|visa sponsorship (?:available|provided)"
YEARS = r"(?i)\b(\d+(?:\.\d+)?)\s*(?:[-–—]|to)\s*(\d+(?:\.\d+)?)\s*years?\b|\b(\d+(?:\.\d+)?)\s*(\+)?\s*years?\b"
PERIODS = {"YEAR": "ANNUAL", "ANNUAL": "ANNUAL", "YEARLY": "ANNUAL", "MONTH": "MONTHLY", "MONTHLY": "MONTHLY", "HOUR": "HOURLY", "HOURLY": "HOURLY", "DAY": "DAILY", "WEEK": "WEEKLY"}


def classify_role(title: Column, description: Column, least_years: Column) -> Column:
    """NRM-01: struct(family, seniority); the first rule that holds decides."""
    t, d = text.normalized_text(title), F.coalesce(description, F.lit(""))
    second = t.rlike(r"\b(ii|2)\b")
    level = F.when(second, "STRETCH").otherwise("EARLY_CAREER")
    both = lambda a, b: F.struct((F.lit(a) if isinstance(a, str) else a).alias("family"), (F.lit(b) if isinstance(b, str) else b).alias("seniority"))
    rule = F.when(t.rlike(SENIOR_TITLE) | d.rlike(SENIOR_SCOPE), both("EXCLUDED", "SENIOR")).when(t.rlike(OTHER_FIELD), both("EXCLUDED", "OUT_OF_SCOPE")).when(second & (least_years.isNull() | (least_years > 3)), both("EXCLUDED", "LEVEL_II_UNCLEAR"))
    for name, pattern in FAMILIES:
        needs_code = name in ("RELIABILITY", "PLATFORM", "FULL_STACK")
        seniority = F.when(~d.rlike(BUILDS_CODE), "REVIEW_SCOPE").otherwise(level) if needs_code else level
        rule = rule.when(t.rlike(pattern), both(name, seniority))
    return rule.otherwise(both("UNKNOWN", "UNKNOWN"))


def parse_experience(description: Column) -> Column:
    """NRM-02: struct(minimum, maximum, text, confidence, internship_allowed).

    Sentences are folded in order; an inverted range ends the fold as AMBIGUOUS, a
    higher lower bound replaces a lower one.
    """
    allowed = description.rlike(r"(?i)internship(?:s)? (?:count|included|accepted)|including internships")
    specific = r"(?i)^\s*(?:of\s+)?(?:experience\s+)?(?:in|with|using)\s+"

    # Lambda bodies are interpreted as written, so what is used twice is bound to a field first.
    number = lambda s, n: F.nullif(F.regexp_extract(s, YEARS, n), F.lit("")).cast("double")
    after = lambda s: F.regexp_replace(s, r"(?is)^.*?(?:" + YEARS.removeprefix("(?i)") + ")", "")
    named = F.filter(text.sentences(description), lambda s: s.rlike(YEARS) & ~s.rlike(OPTIONAL))
    cut = F.transform(named, lambda s: F.struct(F.coalesce(number(s, 1), number(s, 3)).alias("low"), number(s, 2).alias("high"), F.trim(s).alias("text"), after(s).alias("rest")))
    general = r"(?i)software|professional|industry|total|work experience"
    found = F.filter(cut, lambda x: ~x["rest"].rlike(specific) | x["text"].rlike(general) | (F.size(text.tags(x["rest"])) == 0))

    start = F.struct(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit("").alias("text"), F.lit("MISSING").alias("state"))

    def step(best: Column, x: Column) -> Column:
        made = lambda low, high, state: F.struct(low.alias("low"), high.alias("high"), x["text"].alias("text"), F.lit(state).alias("state"))
        none = F.lit(None).cast("double")
        return F.when(best["state"] == "AMBIGUOUS", best).when(x["high"] < x["low"], made(none, none, "AMBIGUOUS")).when(best["low"].isNull() | (x["low"] > best["low"]), made(x["low"], x["high"], "PARSED")).otherwise(best)

    best = F.aggregate(found, start, step)
    return F.struct(best["low"].alias("minimum"), best["high"].alias("maximum"), best["text"].alias("text"), best["state"].alias("confidence"), allowed.alias("internship_allowed"))


def parse_salary(provider: Column, salary: Column) -> Column:
    """NRM-03: struct(kind, low, high, currency, period), null unless explicit and valid."""
    whole = F.try_parse_json(salary)
    path = lambda v, p, t="string": F.try_variant_get(v, p, t)
    is_list = salary.rlike(r"^\s*\[")
    one = F.when(is_list, F.when((provider == "greenhouse") & path(whole, "$[1]").isNull(), F.try_variant_get(whole, "$[0]", "variant"))).otherwise(whole)
    kind_text = F.lower(F.coalesce(*[F.nullif(path(one, f"$.{k}"), F.lit("")) for k in ("compensationType", "type", "title")], F.lit("")))
    jsonld = provider == "jsonld"
    kind = F.when(jsonld, "base").when(F.contains(kind_text, F.lit("base")), "base").when(F.contains(kind_text, F.lit("total")), "total")
    inner = F.when(jsonld, F.coalesce(F.when(path(one, "$.value.minValue").isNotNull() | path(one, "$.value.value").isNotNull() | path(one, "$.value.min").isNotNull(), F.try_variant_get(one, "$.value", "variant")), one)).otherwise(one)
    numeric = lambda k: F.when(F.schema_of_variant(F.try_variant_get(inner, f"$.{k}", "variant")).rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)"), path(inner, f"$.{k}", "double"))
    low = F.coalesce(*map(numeric, ("minValue", "min_cents", "min", "value")))
    high = F.coalesce(*map(numeric, ("maxValue", "max_cents", "max")), low)
    currency = F.upper(F.coalesce(path(one, "$.currency"), F.lit("")))
    unit = F.upper(F.coalesce(*[F.nullif(path(v, f"$.{k}"), F.lit("")) for v, k in ((inner, "unitText"), (one, "interval"), (one, "period"))], F.lit("")))
    named = F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv])
    divisor = F.when((provider == "greenhouse") & is_list, 100.0).otherwise(1.0)
    valid = kind.isNotNull() & low.isNotNull() & (low >= 0) & (high >= low) & ~F.isnan(low) & (high < float("inf")) & currency.rlike("^[A-Z]{3}$")
    return F.when(valid, F.struct(kind.alias("kind"), (low / divisor).alias("low"), (high / divisor).alias("high"), currency.alias("currency"), F.coalesce(F.try_element_at(named, unit), F.lit("UNKNOWN")).alias("period")))


def work_mode(location: Column) -> Column:
    """NRM-04."""
    where = F.lower(F.coalesce(location, F.lit("")))
    return F.when(F.contains(where, F.lit("remote")), "REMOTE").when(F.contains(where, F.lit("hybrid")), "HYBRID").when(where != "", "ONSITE").otherwise("UNKNOWN")


def location_eligible(location: Column, description: Column) -> Column:
    """NRM-04: true, false, or null where nothing is said."""
    place, body = F.coalesce(location, F.lit("")), F.coalesce(description, F.lit(""))
    return F.when(F.lower(F.concat(place, F.lit(" "), body)).rlike(ELSEWHERE), False).when(place.rlike(HOME) | body.rlike(WELCOMES), True)


def skills_by_sentence(description: Column) -> Column:
    """NRM-05: struct(required, preferred), preferred without what is required."""
    parts = text.sentences(description)
    gathered = lambda some: F.array_sort(F.array_distinct(F.flatten(F.transform(some, lambda s: text.tags(s)))))
    required = gathered(F.filter(parts, lambda s: ~s.rlike(OPTIONAL)))
    return F.struct(required.alias("required"), F.array_except(gathered(F.filter(parts, lambda s: s.rlike(OPTIONAL))), required).alias("preferred"))


def normalize_jobs(raw: DataFrame, now: Column, baseline: Column | None = None) -> DataFrame:
    """NRM-06: one silver row per raw row; ``error`` names why a row belongs in quarantine.

    raw: source_id, provider, tenant, provider_job_id, title, company, location,
    description, url, apply_url, fetched_at, posted_at_raw, official_link_state, and
    optionally deadline_raw, salary_text, source_timezone, requisition_id and
    requisition_namespace.
    """
    for optional in ("deadline_raw", "salary_text", "source_timezone", "requisition_id", "requisition_namespace", "tenant", "apply_url"):
        if optional not in raw.columns:
            raw = raw.withColumn(optional, F.lit(None).cast("string"))
    first = baseline if baseline is not None else F.lit(True)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    read = raw.withColumns({"__size": text.bounded(blank("description")), "__text": text.guarded_plain_text(blank("description")), "__url": urls.canonical_url(F.nullif(F.col("url"), F.lit(""))), "__apply": urls.canonical_url(F.nullif(F.col("apply_url"), F.lit("")))})
    read = read.withColumns({"description": F.coalesce("__text", F.lit("")), "canonical_url": F.coalesce("__url.url", F.lit(""))})
    read = read.withColumns({"apply_url": F.coalesce("__apply.url", "canonical_url"), "__exp": parse_experience(F.col("description")), "normalized_company": text.normalized_company(blank("company")), "normalized_title": text.normalized_text(blank("title"))})
    read = read.withColumns({"__role": classify_role(blank("title"), F.col("description"), F.col("__exp.minimum")), "__date": dates.posted_date(F.col("posted_at_raw"), now, F.coalesce("source_timezone", F.lit("UTC"))), "__skills": skills_by_sentence(F.col("description")), "__pay": parse_salary(F.col("provider"), F.col("salary_text"))})
    uid = hashing.record_uid("job_", F.col("provider"), F.col("tenant"), F.col("provider_job_id"), F.col("canonical_url"), F.col("normalized_company"), F.col("title"), F.col("location"), F.col("description"))
    family, d = F.col("__role.family"), F.col("description")
    identity = F.struct("provider", "tenant", "provider_job_id", "canonical_url", "requisition_id", "requisition_namespace")
    return read.select(
        uid.alias("job_uid"), "source_id", "provider", "tenant", "provider_job_id", "company", "normalized_company", "title", "normalized_title", family.alias("role_family"), F.col("__role.seniority").alias("seniority"),
        "location", work_mode(F.col("location")).alias("work_mode"), location_eligible(F.col("location"), d).alias("location_eligible"), text.first_sentence(d, r"(?i)visa|sponsor|relocation").alias("visa_text"),
        text.first_sentence(d, r"(?i)graduat|degree|bachelor").alias("education_constraint"), F.substring(d, 1, 4000).alias("description"), F.sha2(d, 256).alias("description_hash"),
        F.col("__skills.required").alias("required_skills"), F.col("__skills.preferred").alias("preferred_skills"), F.col("__exp.text").alias("experience_text"), F.col("__exp.minimum").alias("min_years"), F.col("__exp.maximum").alias("max_years"),
        F.col("__exp.confidence").alias("experience_confidence"), F.col("__exp.internship_allowed").alias("internship_allowed"), "canonical_url", "apply_url", "official_link_state", F.array(identity).alias("identities"),
        F.col("__date.value").alias("posted_at_source"), F.col("__date.confidence").alias("posted_at_confidence"), F.col("__date.age_min").alias("age_hours_min"), F.col("__date.age_max").alias("age_hours_max"), dates.instant(F.col("deadline_raw")).alias("deadline"),
        now.alias("first_seen_at"), now.alias("last_seen_at"), dates.freshness_band(F.col("__date.age_max"), first).alias("freshness_band"), first.alias("baseline"), F.col("__date.error").alias("quarantine_reason"),
        F.when(family == "EXCLUDED", "OUT_OF_SCOPE_ROLE").otherwise("").alias("exclusion_reason"), F.lit("ACTIVE").alias("active_state"), "__pay.*", F.coalesce("__size", F.col("__url.error"), F.col("__apply.error")).alias("error"),
    )


def split_quarantine(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRD-08: (healthy rows, quarantined rows)."""
    return normalized.where("error is null").drop("error"), normalized.where("error is not null").select("job_uid", "source_id", "error")
