"""Fit and priority scores, and the action ladder (SCR-*, AGG-15, SET-01, JON-05, WIN-02)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import dates, text

# Weights and the worth of each class.
FIT = {"role": 20.0, "experience": 15.0, "skills": 25.0, "evidence": 15.0, "location": 10.0, "responsibility": 10.0, "education": 5.0}
PRIORITY = {"fit": 55.0, "freshness": 15.0, "experience": 8.0, "official_route": 7.0, "target_tier": 5.0, "compensation": 4.0, "contact": 4.0, "deadline": 2.0}
FRESHNESS = {"HOT_0_6H": 1.0, "EARLY_6_24H": 0.9, "FRESH_1_3D": 0.65, "OPEN_4_7D": 0.35, "AGING_8_14D": 0.1, "STALE_15D_PLUS": 0.0, "OBSERVED_NEW_DATE_UNKNOWN": 0.75, "BASELINE_DATE_UNKNOWN": 0.0}
EXPERIENCE = {"IN_RANGE": 1.0, "MEETS": 1.0, "AMBIGUOUS": 0.75, "NEAR_MATCH_IN_SCOPE": 0.55, "STRETCH": 0.25, "OUT_OF_SCOPE": 0.0}
CONTACT = {"CONFIRMED_REFERRER": 1.0, "WARM_CONNECTION": 0.75, "PERMITTED_RECRUITER": 0.4, "PERMITTED_TEAM_CHANNEL": 0.4, "NONE": 0.0}
NOT_STARTED = ("", "NOT_APPLIED", "NOT_STARTED", "NOT_REVIEWED", "REVIEWING", "READY_TO_APPLY", "NEW", "NONE")


@dataclass(frozen=True)
class ScoringConfig:
    """SCR-01: both sets of weights total 100."""

    fit: dict[str, float] = field(default_factory=lambda: dict(FIT))
    priority: dict[str, float] = field(default_factory=lambda: dict(PRIORITY))
    p0: tuple[float, float, float] = (75.0, 85.0, 24.0)  # fit, priority, age in hours
    p1: tuple[float, float, float] = (60.0, 70.0, 192.0)
    p2_priority: float = 50.0
    stale_penalty: float = 10.0
    unverified_penalty: float = 10.0
    duplicate_penalty: float = 25.0

    def __post_init__(self) -> None:
        if any(abs(sum(w.values()) - 100) > 0.001 for w in (self.fit, self.priority)):
            raise ValueError("weights must total 100")


@dataclass(frozen=True)
class Profile:
    """The candidate; one small record, so its values are literals of the plan."""

    full_time_start: str
    skills: tuple[str, ...]
    evidence: tuple[tuple[str, tuple[str, ...]], ...] = ()  # id, tags and technologies
    graduation_year: int | None = None
    internship: tuple[str, str] | None = None
    target_base_lpa: float | None = None
    current_base_lpa: float | None = None
    company_tiers: tuple[tuple[str, float], ...] = ()


def weighted(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """AGG-15."""
    return reduce(lambda a, b: a + b, [signals[k] * F.lit(w) for k, w in weights.items()])


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def look_up(x: Column, worth: dict[str, float], default: float = 0.0) -> Column:
    return reduce(lambda c, kv: c.when(x == kv[0], F.lit(kv[1])), list(worth.items())[1:], F.when(x == next(iter(worth)), F.lit(next(iter(worth.values()))))).otherwise(F.lit(default))


def experience_fit(required: Column, low: Column, high: Column) -> Column:
    """SCR-02."""
    return F.when(required.isNull(), "AMBIGUOUS").when(required >= 4, "OUT_OF_SCOPE").when(required >= 3, "STRETCH").when(required == 0, "IN_RANGE").when(low >= required, "MEETS").when(high >= required, "AMBIGUOUS").otherwise("NEAR_MATCH_IN_SCOPE")


def select_evidence(jobs: DataFrame, evidence: DataFrame, top: int = 2) -> DataFrame:
    """SCR-03: (job_uid, evidence_id, overlap) of the top pieces by shared tokens.

    evidence: evidence_id, words (array). A token is matched by an equi-join on it, so
    neither side is broadcast or crossed.
    """
    token = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("token")
    terms = jobs.select("job_uid", token(text.normalized_text(F.concat_ws(" ", "description", "title")))).where("token <> ''")
    words = evidence.select("evidence_id", token(text.normalized_text(F.array_join("words", " ")))).where("token <> ''")
    overlap = terms.join(words, "token").groupBy("job_uid", "evidence_id").agg(F.count("*").alias("overlap"))
    place = F.row_number().over(Window.partitionBy("job_uid").orderBy(F.desc("overlap"), "evidence_id"))
    return overlap.withColumn("place", place).where(F.col("place") <= top)


def evidence_count(description: Column, title: Column, profile: Profile, top: int = 2) -> Column:
    """How many pieces of the profile's evidence share a token with the record."""
    terms = F.split(text.normalized_text(F.concat_ws(" ", description, title)), " ")
    hits = [F.arrays_overlap(terms, F.filter(F.split(text.normalized_text(F.lit(" ".join(words))), " "), lambda w: w != "")).cast("int") for _, words in profile.evidence]
    return F.least(F.lit(top), reduce(lambda a, b: a + b, hits)) if hits else F.lit(0)


def compensation_signal(kind: Column, low: Column, currency: Column, period: Column, source: Column, profile: Profile) -> Column:
    """SCR-04."""
    if profile.target_base_lpa is None or profile.current_base_lpa is None:
        return F.lit(0.5)
    known = F.coalesce((currency == "INR") & (period == "ANNUAL") & (kind == "base") & low.isNotNull() & (source != ""), F.lit(False))
    lakhs = low / 100_000
    return F.when(~known, 0.5).when(lakhs >= profile.target_base_lpa, 1.0).when(lakhs > profile.current_base_lpa, 0.75).otherwise(0.25)


def skill_ratio(required: Column, preferred: Column, own: Column) -> Column:
    """SCR-05."""
    share = lambda a: (F.size(a) - F.size(F.array_except(a, own))) / F.size(a)
    base = F.when(F.size(required) > 0, share(required)).otherwise(0.5)
    return F.when(F.size(preferred) > 0, 0.9 * base + 0.1 * share(preferred)).otherwise(base)


def ladder(fit: Column, priority: Column, route: Column, age_max: Column, observed_new: Column, changed: Column, quarantined: Column, exclusion: Column, stage: Column, cfg: ScoringConfig | None = None) -> Column:
    """SCR-09: struct(priority, eligibility); the first rung that holds."""
    cfg = cfg or ScoringConfig()
    young = lambda hours: F.coalesce((age_max >= 0) & (age_max < hours), F.lit(False)) | observed_new
    rung = lambda need, fresh: (fit >= need[0]) & (priority >= need[1]) & route & fresh & ~quarantined
    both = lambda a, b: F.struct(F.lit(a).alias("priority"), (b if isinstance(b, Column) else F.lit(b)).alias("eligibility"))
    review = F.when(quarantined, "QUARANTINED").when(~route, "NEEDS_OFFICIAL_LINK").otherwise("NEEDS_REVIEW")
    return (
        F.when(~F.coalesce(stage, F.lit("")).isin(*NOT_STARTED), both("PIPELINE", "TRACKING"))
        .when(F.coalesce(exclusion, F.lit("")) != "", both("EXCLUDED", "BLOCKED_HARD"))
        .when(rung(cfg.p0, young(cfg.p0[2])), both("P0", "READY"))
        .when(rung(cfg.p1, young(cfg.p1[2]) | changed), both("P1", "READY"))
        .when(priority >= cfg.p2_priority, both("P2", review))
        .otherwise(both("P3", review))
    )


def score_jobs(jobs: DataFrame, profile: Profile, now: Column, cfg: ScoringConfig | None = None) -> DataFrame:
    """SCR-05 to SCR-11 over silver records: one narrow projection, no shuffle.

    Optional columns: contact_readiness, application_stage, manual_include,
    manual_priority, source_health, last_changed_at, hard_blocker.
    """
    cfg = cfg or ScoringConfig()
    for name, kind in (("contact_readiness", "string"), ("application_stage", "string"), ("manual_include", "boolean"), ("manual_priority", "double"), ("source_health", "string"), ("last_changed_at", "timestamp"), ("hard_blocker", "string")):
        if name not in jobs.columns:
            jobs = jobs.withColumn(name, F.lit(None).cast(kind))
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    intern = profile.internship or (None, None)
    tenure = dates.tenure_years(now, F.lit(profile.full_time_start), F.lit(intern[0]).cast("string"), F.lit(intern[1]).cast("string"), c("internship_allowed"))
    own = F.array_union(text.tags(F.lit("; ".join(profile.skills))), F.array(*map(F.lit, profile.skills)))
    year = F.nullif(F.regexp_extract("education_constraint", r"(?i)(?:class of|graduates? (?:of|from)|graduat(?:ing|ion) (?:in|year))\s*(20\d{2})", 1), F.lit(""))
    wrong_year = yes(year.cast("int") != F.lit(profile.graduation_year)) if profile.graduation_year else year.isNotNull()
    step = jobs.withColumns({"__tenure": tenure, "__included": yes(c("manual_include")), "__wrong_year": wrong_year})
    step = step.withColumn("experience_fit", experience_fit(c("min_years"), c("__tenure.low"), c("__tenure.high")))
    exp_worth = look_up(c("experience_fit"), EXPERIENCE)
    dims = {
        "role": F.when(c("seniority") == "STRETCH", 0.8).when(c("role_family").isin("UNKNOWN", "EXCLUDED") | (c("seniority") == "REVIEW_SCOPE"), 0.4).otherwise(1.0),
        "experience": exp_worth, "skills": skill_ratio(c("required_skills"), c("preferred_skills"), own), "evidence": evidence_count(c("description"), c("title"), profile) / 2,
        "location": F.when(c("location_eligible").isNull(), 0.5).when(c("location_eligible"), 1.0).otherwise(0.0),
        "responsibility": F.when(c("description").rlike("(?i)develop|build|design|software|backend|api"), 1.0).otherwise(0.5), "education": F.when(c("__wrong_year"), 0.0).otherwise(1.0),
    }
    step = step.withColumn("dimensions", F.struct(*[v.cast("double").alias(k) for k, v in dims.items()]))
    step = step.withColumn("fit_score", F.round(weighted({k: c(f"dimensions.{k}") for k in dims}, cfg.fit), 4))
    early = F.when(c("active_state") == "CLOSED", "VERIFIED_CLOSED").when(yes(~c("location_eligible")), "LOCATION_INELIGIBLE").when(~c("__included") & ((c("role_family") == "EXCLUDED") | (c("experience_fit") == "OUT_OF_SCOPE")), "OUT_OF_SCOPE_ROLE_OR_EXPERIENCE").otherwise(c("exclusion_reason"))
    exclusion = F.when((c("experience_fit") == "STRETCH") & (c("fit_score") < 75) & ~c("__included"), "THREE_YEAR_STRETCH_BELOW_FIT_75").when(F.coalesce(c("hard_blocker"), F.lit("")) != "", F.concat(F.lit("VERIFIED_HARD_CONSTRAINT: "), "hard_blocker")).when(c("__wrong_year"), "GRADUATION_YEAR_INELIGIBLE").otherwise(early)
    elapsed = F.greatest(F.lit(0.0), dates.hours_between(c("last_seen_at"), now))
    step = step.withColumns({"exclusion_reason": exclusion, "__age": c("age_hours_max") + elapsed})
    until = dates.hours_between(now, c("deadline"))
    route = yes(c("official_link_state") == "VERIFIED_OFFICIAL") & yes(F.startswith(c("apply_url"), F.lit("https://")))
    tiers = dict(profile.company_tiers)
    signals = {
        "fit": c("fit_score") / 100, "freshness": look_up(dates.freshness_band(c("__age"), c("baseline")), FRESHNESS), "experience": exp_worth, "official_route": route.cast("double"),
        "target_tier": clamp(look_up(c("normalized_company"), tiers), 0.0, 1.0) if tiers else F.lit(0.0), "compensation": compensation_signal(c("kind"), c("low"), c("currency"), c("period"), c("canonical_url"), profile),
        "contact": look_up(c("contact_readiness"), CONTACT), "deadline": F.when(until.between(0, 48), 1.0).when(until.between(0, 168), 0.5).otherwise(0.0),
    }
    penalty = F.when(yes(c("source_health").isin("STALE", "DOWN")), cfg.stale_penalty).otherwise(0.0) + F.when(~yes(c("official_link_state") == "VERIFIED_OFFICIAL"), cfg.unverified_penalty).otherwise(0.0) + F.when(yes(c("quarantine_reason") == "UNRESOLVED_DUPLICATE_GRAY_ZONE"), cfg.duplicate_penalty).otherwise(0.0)
    step = step.withColumn("priority_score", F.round(clamp(F.coalesce("manual_priority", weighted(signals, cfg.priority) - penalty)), 4))
    new = ~c("baseline") & (c("freshness_band") == "OBSERVED_NEW_DATE_UNKNOWN")
    changed = yes(c("active_state") == "CHANGED") & (~c("baseline") | yes(c("last_changed_at") > c("first_seen_at")))
    step = step.withColumn("__step", ladder(c("fit_score"), c("priority_score"), route, c("__age"), new, changed, yes(c("quarantine_reason") != ""), c("exclusion_reason"), c("application_stage"), cfg))
    hours = F.when(c("__step.priority") == "P0", 2).when(c("__step.priority") == "P1", 12).when(c("__step.priority") == "P2", 48).when(c("__step.priority") == "P3", 168)
    due = F.coalesce(dates.ist(F.timestamp_add("HOUR", hours, c("first_seen_at"))), F.lit(""))
    missing = lambda label, a: F.transform(F.array_except(a, own), lambda s: F.concat(F.lit(label), s))
    reasons = F.array(*[F.format_string(f"{k}: %.2f/{w:g}", c(f"dimensions.{k}") * w) for k, w in cfg.fit.items()])
    band = F.when(c("priority_score") >= 85, "S0").when(c("priority_score") >= 70, "S1").when(c("priority_score") >= 50, "S2").otherwise("S3")
    return step.withColumns({
        "action_priority": c("__step.priority"), "action_eligibility": c("__step.eligibility"), "score_band": band, "action_by_ist": due, "reasons": reasons,
        "gaps": F.concat(missing("Required skill absent from profile: ", c("required_skills")), missing("Preferred skill gap: ", c("preferred_skills"))),
        "next_action": F.when(c("__step.priority") == "PIPELINE", F.concat(F.lit("Continue the workflow at "), "application_stage")).otherwise(c("__step.eligibility")),
    }).drop("__tenure", "__included", "__wrong_year", "__age", "__step")
