"""Typed loaders, manual values as of a time, and settings from a table."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import overrides


def test_cells_lie_over_the_stored_model(spark):
    rows = [("a", '{"n": 1, "hosts": ["x"], "name": "stored", "metadata": {"policy_stop": "LOGIN_REQUIRED"}, "policy_state": "APPROVED"}', "", '["y", "z"]', " "), ("b", "broken", "7", "", "cell"), ("c", None, "bad", None, None), ("d", '{"n": 3}', "4", "no json", "x")]
    frame = spark.createDataFrame(rows, "key string, model_json string, n string, hosts string, name string")
    schema = "n int, hosts array<string>, name string, metadata map<string, string>, policy_state string"
    found = {r["key"]: (r["n"], r["hosts"], r["name"], r["policy_state"]) for r in overrides.load_sources(frame, schema).collect()}
    assert found == {"a": (1, ["y", "z"], " ", "LOGIN_REQUIRED"), "b": (7, None, "cell", None), "c": (None, None, None, None), "d": (4, None, "x", None)}


def test_records_keep_their_stored_fields(spark):
    frame = spark.createDataFrame([('{"n": 1}', 5, "TRUE"), ('{"n": 2}', 6, ""), ("", 7, None)], "model_json string, n int, do_not_merge string")
    assert sorted((r["n"], r["do_not_merge"]) for r in overrides.load_jobs(frame, "n int").where("n is not null").collect()) == [(1, True), (2, False)]
    people = overrides.load_contacts(spark.createDataFrame([("x", "", "true")], "name string, phone string, whatsapp_allowed string"), "name string, phone string, whatsapp_allowed boolean")
    assert tuple(people.first()) == ("x", None, True)


@pytest.mark.parametrize("block", [2, 1000])
def test_the_last_override_counts_if_it_has_a_reason(spark, block):
    rng = random.Random(block)
    records = [(n, rng.choice(["hot", "hot", "a", None]), rng.randint(0, 30)) for n in range(50)]
    changes = [(rng.choice(["hot", "a"]), at, float(at), rng.choice(["", " ", None, "why"])) for at in rng.sample(range(30), 18)]
    found = overrides.manual_as_of(spark.createDataFrame(records, "id long, job string, at long"), spark.createDataFrame(changes, "job string, at long, priority double, reason string"), "job", "at", ["priority"], block_rows=block)
    for r in found.collect():
        held = max(((at, p, why) for job, at, p, why in changes if job == r["job"] and at <= r["at"]), default=(0, None, None))
        assert r["priority"] == (held[1] if (held[2] or "").strip() else None)
    assert found.count() == 50


def test_due_is_never_later(spark):
    rows = [("2026-01-02", "2026-01-01", "2026-01-01"), ("2026-01-02", "2026-01-03", "2026-01-02"), ("", "2026-01-03", ""), ("2026-01-02", None, "2026-01-02"), (None, "x", None)]
    found = spark.createDataFrame(rows, "new string, old string, wanted string").select("wanted", overrides.due_no_later(F.col("new"), F.col("old")).alias("due")).collect()
    assert all(r["due"] == r["wanted"] for r in found)


def test_settings_from_a_table(spark):
    schema = "name string, value double, set_at int"
    rows = [("fit.role", 10.0, 1), ("fit.role", 15.0, 3), ("fit.skills", 30.0, 2), ("p2_priority", 40.0, 1), ("unheard.of", 1.0, 1), ("fit.role", 99.0, 9)]
    found = overrides.scoring_config(spark, spark.createDataFrame(rows, schema), F.lit(5))
    assert (found.fit["role"], found.fit["skills"], found.p2_priority, found.stale_penalty) == (15.0, 30.0, 40.0, 10.0)
    with pytest.raises(ValueError):
        overrides.scoring_config(spark, spark.createDataFrame(rows[:1], schema))
