"""Entity resolution against taking in row after row."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import ordered, resolve

NOW = datetime(2026, 8, 15)
IDENTITY = "provider string, tenant string, provider_job_id string, canonical_url string, requisition_id string, requisition_namespace string"
SCHEMA = (
    f"seq long, job_uid string, normalized_company string, title string, normalized_title string, location string, work_mode string, description string, description_hash string, experience_text string, deadline timestamp, apply_url string, canonical_url string, "
    f"official_link_state string, identities array<struct<{IDENTITY.replace(' string', ': string')}>>, provenance array<struct<source_id: string, url: string, note: string>>, posted_at_source timestamp, posted_at_confidence string, age_hours_min double, age_hours_max double, first_seen_at timestamp, "
    "last_seen_at timestamp, baseline boolean, quarantine_reason string, active_state string, do_not_merge boolean, missing_snapshots int, last_missing_at timestamp, dedupe_group_id string"
)
NAMES = [x.split()[0] for x in SCHEMA.replace("array<struct<", "array<").split(", ") if " " in x]


def row(seq, **changes):
    identity = {k.split()[0]: "" for k in IDENTITY.split(", ")} | {"provider": "p", "tenant": "t"}
    base = {
        "seq": seq, "job_uid": f"u{seq}", "normalized_company": "acme", "title": "backend engineer", "normalized_title": "backend engineer", "location": "Pune", "work_mode": "ONSITE", "description": "java work on services", "description_hash": "h", "experience_text": "", "deadline": None,
        "apply_url": "", "canonical_url": "", "official_link_state": "VERIFIED_OFFICIAL", "identities": None, "provenance": [("s", f"w{seq}", "")], "posted_at_source": None, "posted_at_confidence": "MISSING", "age_hours_min": None, "age_hours_max": None, "first_seen_at": NOW, "last_seen_at": NOW,
        "baseline": True, "quarantine_reason": "", "active_state": "ACTIVE", "do_not_merge": False, "missing_snapshots": 2, "last_missing_at": NOW, "dedupe_group_id": None,
    }
    own = {k: v for k, v in changes.items() if k in identity and k != "canonical_url"}
    return base | {"identities": [identity | own]} | {k: v for k, v in changes.items() if k in base}


def table(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in row(0)) for r in rows], SCHEMA)


class Plain:
    """Records as lists of the rows they took in; all that is known of a record is read from them."""

    def __init__(self, limits):
        self.limits, self.records, self.audit = limits, [], []

    @staticmethod
    def contents(members):
        """The row that was the content after each member."""
        out = []
        for m in members:
            official = m["official_link_state"] == "VERIFIED_OFFICIAL"
            out.append(m if not out or official or out[-1]["official_link_state"] != "VERIFIED_OFFICIAL" else out[-1])
        return out

    @staticmethod
    def spaces(rows, kind):
        first, value = {"id": (("provider", "tenant"), "provider_job_id"), "req": (("requisition_namespace",), "requisition_id")}[kind]
        return {(tuple(i[f] for f in first), i[value]) for r in rows for i in r["identities"] if i[value] and (kind == "id" or i[first[0]])}

    def why(self, members, new):
        content = self.contents(members)[-1]
        if members[0]["job_uid"] == new["job_uid"]:
            return "PERSISTED_UID"
        company = content["normalized_company"] == new["normalized_company"]
        clash = {k: any(s == t and v != w for s, v in self.spaces(members, k) for t, w in self.spaces([new], k)) for k in ("id", "req")}
        if content["do_not_merge"] or new["do_not_merge"] or clash["id"] or (clash["req"] and company):
            return None
        if self.spaces(members, "id") & self.spaces([new], "id"):
            return "EXACT_PROVIDER_ID"
        if content["canonical_url"] and content["canonical_url"] == new["canonical_url"]:
            return "EXACT_CANONICAL_URL"
        if not company or not new["normalized_company"]:
            return None
        if self.spaces(members, "req") & self.spaces([new], "req"):
            return "EXACT_REQUISITION"
        wanted = ("location", "description", "normalized_title")
        if not all(r[f] for r in (content, new) for f in wanted) or any(content[f] != new[f] for f in ("location", "work_mode")):
            return None
        known = [m["posted_at_source"] for m, c in zip(members, self.contents(members), strict=True) if c is m and m["posted_at_source"]]
        since = min(known) if known else min(m["first_seen_at"] for m in members)
        if abs(since - (new["posted_at_source"] or new["first_seen_at"])) > timedelta(days=self.limits.days):
            return None
        title = resolve.similarity(content["normalized_title"], new["normalized_title"])
        a, b = (set(r["description"].split()) for r in (content, new))
        body = 100 * len(a & b) / len(a | b)
        if title >= self.limits.title and body >= self.limits.body:
            return "EXACT_FINGERPRINT" if all(content[f] == new[f] for f in ("description_hash", "normalized_title")) else "FUZZY_HIGH_CONFIDENCE"
        return "GRAY_ZONE" if title >= self.limits.gray_title and body >= self.limits.gray_body else None

    def take(self, new):
        found = [(n, self.why(m, new)) for n, m in enumerate(self.records)]
        sure = next(((n, why) for n, why in found if why and why != "GRAY_ZONE"), None)
        if sure is None:
            gray = any(why for _, why in found)
            self.records.append([dict(new, gray=gray)])
            self.audit.append((new["seq"], new["job_uid"], "NEW", "GRAY_ZONE" if gray else "DISTINCT_IDENTITY", ()))
            return
        members = self.records[sure[0]]
        before = self.contents(members)[-1]
        members.append(new)
        after = self.contents(members)[-1]
        changed = tuple(f for f in resolve.MATERIAL if before[f] != after[f])
        reopened = len(members) == 2 and members[0]["active_state"] in ("CLOSED", "POSSIBLY_CLOSED")
        self.audit.append((new["seq"], members[0]["job_uid"], "REOPENED" if reopened else "CHANGED" if changed else "MERGED", sure[1], changed))

    def summary(self):
        events = {a[0]: a for a in self.audit}
        out = []
        for members in self.records:
            contents = self.contents(members)
            content, last = contents[-1], events[members[-1]["seq"]]
            unite = lambda name, by: list({tuple(e[b] for b in by): None for m in members for e in m[name]})  # noqa: E731, B023
            posted, low, seen = None, None, None
            for m, c in zip(members, contents, strict=True):
                now = m["last_seen_at"] if seen is None else max(seen, m["last_seen_at"])
                if c is m:
                    if posted is not None and (m["posted_at_source"] is None or posted < m["posted_at_source"]):
                        low = None if low is None else low + (now - seen).total_seconds() / 3600
                    else:
                        posted, low = m["posted_at_source"], m["age_hours_min"]
                seen = now
            state = members[0]["active_state"] if len(members) == 1 else {"MERGED": "ACTIVE"}.get(last[2], last[2])
            changes = [events[m["seq"]] for m in members[1:] if events[m["seq"]][4]]
            gray = members[0]["gray"] and content["seq"] == members[0]["seq"]
            out.append((
                members[0]["seq"], members[0]["job_uid"], content["title"], len(members), len(changes), state, min(m["first_seen_at"] for m in members), seen, posted, None if low is None else round(low, 6), resolve.GRAY if gray else content["quarantine_reason"],
                [tuple(x) for x in unite("identities", list(members[0]["identities"][0]))], [tuple(x) for x in ({e[:2]: e for m in reversed(members) for e in reversed(m["provenance"])}[k] for k in dict.fromkeys(e[:2] for m in members for e in m["provenance"]))],
                0 if len(members) > 1 else 2, None if len(members) > 1 else NOW,
            ))
        return sorted(out, key=lambda x: x[0])


def check(spark, rows, limits=None, block_rows=100_000):
    limits = limits or resolve.Thresholds()
    plain = Plain(limits)
    for r in sorted(rows, key=lambda r: r["seq"]):
        plain.take(r)
    found, audit = resolve.resolve_audited(spark, table(spark, rows).repartition(3), limits, block_rows)
    told = sorted((r["seq"], r["job_uid"], r["event"], r["reason"], tuple(f for f in resolve.MATERIAL if f in r["diff"])) for r in audit.collect())
    assert told == plain.audit
    fields = ("seq", "job_uid", "title", "members", "changes", "active_state", "first_seen_at", "last_seen_at", "posted_at_source", "age_hours_min", "quarantine_reason", "identities", "provenance", "missing_snapshots", "last_missing_at")
    got = [tuple([tuple(x) for x in r[f]] if f in ("identities", "provenance") else round(r[f], 6) if isinstance(r[f], float) else r[f] for f in fields) for r in found.collect()]
    assert sorted(got, key=lambda x: x[0]) == plain.summary()
    return plain


def test_reasons(spark):
    """Pairs of rows at an employer of their own, one for each reason."""
    later = NOW - timedelta(days=46)
    pairs = [
        ({"provider_job_id": "1"}, {"provider_job_id": "1"}), ({"provider_job_id": "1", "canonical_url": "u2"}, {"provider_job_id": "2", "canonical_url": "u2"}), ({"canonical_url": "u", "normalized_company": "x"}, {"canonical_url": "u"}), ({"requisition_id": "1", "requisition_namespace": "n"}, {"requisition_id": "1", "requisition_namespace": "n"}),
        ({}, {}), ({}, {"description_hash": "other"}), ({}, {"work_mode": "REMOTE"}), ({}, {"normalized_company": "x"}), ({}, {"posted_at_source": later}), ({}, {"description": "java work on services now"}), ({"title": "a", "normalized_title": "backend engineer", "official_link_state": "X"}, {"title": "b"}),
        ({"job_uid": "same"}, {"job_uid": "same", "normalized_company": "other", "do_not_merge": True}), ({"active_state": "CLOSED"}, {}), ({"do_not_merge": True}, {}), ({"location": ""}, {"location": ""}), ({"description": None}, {"description": None}), ({"normalized_company": None, "canonical_url": "u9"}, {"normalized_company": None, "canonical_url": "u9"}),
    ]
    rows = []
    for n, pair in enumerate(pairs):
        for m, changes in enumerate(pair):
            rows.append(row(2 * n + m, **({"normalized_company": f"employer {n}", "tenant": f"t{n}"} | changes)))
    plain = check(spark, rows)
    assert {a[3] for a in plain.audit} == {"DISTINCT_IDENTITY", "GRAY_ZONE", "PERSISTED_UID", "EXACT_PROVIDER_ID", "EXACT_CANONICAL_URL", "EXACT_REQUISITION", "EXACT_FINGERPRINT", "FUZZY_HIGH_CONFIDENCE"}


def any_row(rng, seq, words):
    body = list(words)
    for _ in range(rng.choice([0, 0, 1, 2, 3])):
        body[rng.randrange(len(body))] = rng.choice(["alpha", "beta", "gamma"])
    title = rng.choice(["backend engineer two", "backend engineer twos", "backend engineers two", "data engineer", "backend engineer tw"])
    pick = lambda *x: rng.choice(x)
    at = NOW + timedelta(hours=rng.randint(0, 90))
    identity = {"provider": pick("p", "q"), "tenant": pick("t", "u"), "provider_job_id": pick("", "", "1", "2"), "canonical_url": "", "requisition_id": pick("", "", "r1", "r2"), "requisition_namespace": pick("", "n")}
    return row(seq, job_uid=f"u{rng.randint(0, 400)}", normalized_company=pick("acme", "acme", "bolt"), title=title, normalized_title=title, work_mode=pick("ONSITE", "ONSITE", "REMOTE"), description=" ".join(body), description_hash=pick("h", "i"), canonical_url=pick("", "", "", "u1", "u2"), official_link_state=pick("VERIFIED_OFFICIAL", "X", "X"),
               posted_at_source=pick(None, None, NOW - timedelta(days=rng.randint(0, 80))), age_hours_min=pick(None, 3.0), first_seen_at=at, last_seen_at=at, active_state=pick("ACTIVE", "CLOSED"), do_not_merge=rng.random() < 0.04, quarantine_reason=pick("", "own")) | {"identities": [identity]}


@pytest.mark.parametrize("seed", range(2))
def test_random_rows_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    words = [f"word{n}" for n in range(24)]
    rows = [any_row(rng, seq, words) for seq in rng.sample(range(500), 70)]
    check(spark, rows, block_rows=rng.choice([1, 7, 100_000]))


def test_other_limits(spark):
    rng = random.Random(77)
    rows = [any_row(rng, seq, [f"word{n}" for n in range(12)]) for seq in range(50)]
    check(spark, rows, replace(resolve.Thresholds(), title=101.0, days=20))


def test_a_chain_that_holds_a_third_of_all_rows(spark):
    """A record whose rows drift: each is near the one before, the last is far from the first."""
    words = [f"word{n}" for n in range(60)]
    rows = [row(n, description=" ".join(words[: 60 - n % 3] + [f"new{k}" for k in range(n // 12)]), description_hash=f"h{n}", official_link_state="X") for n in range(60)]
    rows += [row(100 + n, normalized_company=f"employer {n}", description=f"own body {n}") for n in range(120)]
    plain = check(spark, rows, block_rows=10)
    assert max(len(m) for m in plain.records) >= 20


def test_parts_of_few_rows_take_no_rounds(spark, monkeypatch):
    """Near copies, rows tied by ids only and rows tied to nothing are folded; so many copies are not compared pair by pair."""
    rng, compared = random.Random(5), []
    words = [f"word{n}" for n in range(40)]
    rows = [any_row(rng, seq, words[:24]) for seq in range(40)]
    rows += [row(100 + n, normalized_company="copies", description=" ".join([*words[:38], f"new{n % 30}", f"more{n % 7}"]), description_hash=f"h{n}") for n in range(90)]
    rows += [row(300 + n, normalized_company=f"employer {n}", description=f"own body {n}") for n in range(30)]

    def refuse(*_, **__):
        raise AssertionError("a round")

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    plain = resolve.compared
    monkeypatch.setattr(resolve, "judged", refuse)
    monkeypatch.setattr(resolve, "compared", counted)
    check(spark, rows)
    assert 0 < sum(compared) < 90 * 89 / 4


def test_no_rows(spark):
    found, audit = resolve.resolve_audited(spark, table(spark, []))
    assert found.count() == 0 and audit.count() == 0


def test_ordered_union_keeps_the_first_of_each_kind(spark):
    rows = spark.createDataFrame([("k", 2, [("a", "late"), ("b", "x")]), ("k", 1, [("c", "y"), ("a", "early"), ("c", "z")]), ("m", 1, []), ("n", 1, None)], "key string, at long, entries array<struct<kind: string, note: string>>")
    found = {r["key"]: [tuple(x) for x in r["entries"]] for r in ordered.ordered_union(rows, "key", "at", "entries", ["kind"]).collect()}
    assert found == {"k": [("c", "y"), ("a", "early"), ("b", "x")]}


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_values_before_a_row(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("ab"), rng.randint(0, 20), rng.choice([None, *range(9)])) for _ in range(80)]
    frame = spark.createDataFrame(rows, "key string, at long, x long")
    found = ordered.before(frame, ["key"], "at", {"least": ("min", F.col("x")), "most": ("max", F.col("x")), "total": ("sum", F.col("x"))}, block)
    for r in found.collect():
        held = [x for k, at, x in rows if k == r["key"] and at < r["at"] and x is not None]
        assert (r["least"], r["most"], r["total"]) == ((min(held), max(held), sum(held)) if held else (None, None, None))


@pytest.mark.parametrize(("block", "inclusive"), [(1, True), (5, False), (1000, True)])
def test_last_known_value(spark, block, inclusive):
    rng = random.Random(block)
    left = [(n, rng.choice(["a", "b", None]), rng.choice([None, *range(15)])) for n in range(60)]
    right = [(rng.choice(["a", "b", None]), at, rng.choice([None, at * 10])) for at in rng.sample(range(15), 9)]
    found = ordered.as_of(spark.createDataFrame(left, "id long, key string, at long"), spark.createDataFrame(right, "key string, at long, value long"), ["key"], "at", ["value"], inclusive, block)
    assert found.count() == 60
    for r in found.collect():
        held = [(at, v) for k, at, v in right if r["at"] is not None and k is not None and k == r["key"] and (at <= r["at"] if inclusive else at < r["at"])]
        assert r["value"] == (max(held, key=lambda x: x[0])[1] if held else None)


@pytest.mark.parametrize("group", [None, ["key"]])
def test_rank_in_many_tasks(spark, group):
    rows = [(("hot" if n % 3 else f"k{n % 5}") if n % 17 else None, n * 7919 % 1000) for n in range(1000)]
    frame = spark.createDataFrame(rows, "key string, x long").repartition(5)
    found = ordered.numbered(spark, frame, [F.desc("x")], group)
    assert found.count() == 1000
    for key in {k for k, _ in rows} if group else {None}:
        held = sorted(((r["rank"], r["x"]) for r in found.collect() if not group or r["key"] == key))
        assert held == [(n + 1, x) for n, x in enumerate(sorted((x for k, x in rows if not group or k == key), reverse=True))]
