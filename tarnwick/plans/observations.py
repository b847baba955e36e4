"""Authored observations for the replay: nine openings, three of them seen twice."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from tarnwick.operators.score import Profile

NOW = "2026-09-14 03:00:00"
_CLOCK = datetime.fromisoformat(NOW)
_WORK = "Develop backend services in Java and Python on Spring Boot with PostgreSQL and Redis. Required total professional experience: 0-2 years. Own the tests of distributed systems. Bachelor degree or similar practice. Pune, India."
_OTHER = "Develop a backend service in Go, C++ and Kotlin. Required total experience: 0-2 years. Pune, India."

PROFILE = Profile(
    full_time_start="2024-06",
    skills=("Java", "Python", "Spring Boot", "PostgreSQL", "Redis", "Kafka", "Docker", "distributed systems"),
    evidence=(("api", ("api", "backend", "reliability", "Java", "PostgreSQL", "Spring Boot")), ("cache", ("backend", "reliability", "distributed systems", "Redis", "Python"))),
    graduation_year=2024,
    internship=("2024-01", "2024-05"),
)

# name, provider, title, age in hours (None: not stated), verified link, description
_OPENINGS = (
    ("alder", "greenhouse", "Backend Engineer", 1.0, True, _WORK),
    ("birch", "lever", "Software Engineer I", 4.0, True, _WORK),
    ("cedar", "ashby", "Java Backend Engineer", 30.0, True, _WORK),
    ("dogwood", "greenhouse", "SDE-I", 72.0, True, _WORK),
    ("elm", "lever", "Backend Developer", None, True, _WORK),
    ("fir", "ashby", "Spring Boot Engineer", 240.0, True, _WORK),
    ("ginkgo", "greenhouse", "Java Developer", 3.0, False, _WORK),
    ("hazel", "lever", "Backend Engineer", 700.0, False, _OTHER),
    ("ivy", "ashby", "Senior Staff Engineer", 2.0, True, _WORK),
)
_AGAIN = ((0, "email"), (1, "rss"), (2, "manual"))


def rows() -> list[dict[str, str | None]]:
    found = []
    for n, (place, provider) in enumerate([*((i, o[1]) for i, o in enumerate(_OPENINGS)), *_AGAIN]):
        name, _, title, age, verified, description = _OPENINGS[place]
        posted = None if age is None else (_CLOCK - timedelta(hours=age)).isoformat() + "+00:00"
        own = n < len(_OPENINGS)
        url = f"https://jobs.example.org/{name}/1"
        found.append({
            "source_id": f"authored-{provider}", "provider": provider, "tenant": name if own else "", "provider_job_id": f"{name}-1" if own else f"seen-{place}", "title": title, "company": f"{name.title()} Works Pvt Ltd", "location": "Pune, India",
            "description": description, "url": url, "apply_url": f"{url}/apply", "fetched_at": NOW, "posted_at_raw": posted, "official_link_state": "VERIFIED_OFFICIAL" if verified else "OFFICIAL_LINK_UNVERIFIED",
        })
    return found


def raw(spark: SparkSession) -> DataFrame:
    found = rows()
    return spark.createDataFrame([tuple(r.values()) for r in found], ", ".join(f"{k} string" for k in found[0]))


def order(spark: SparkSession) -> DataFrame:
    """Arrival order of the rows."""
    keys = ("source_id", "title", "company", "official_link_state")
    return spark.createDataFrame([(n, *(r[k] for k in keys)) for n, r in enumerate(rows())], "seq long, " + ", ".join(f"{k} string" for k in keys))
