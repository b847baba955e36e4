"""Decontamination, quality rules and toxicity: brute force and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import SMALL

from tarnwick.llm import boosting, decontaminate, quality, toxicity
from tarnwick.tables import read_table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def hits(texts, items, window):
    known = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        k = min(window, len(w))
        for j in range(len(w) - k + 1) if k else ():
            known.setdefault(tuple(w[j : j + k]), set()).add(item)
    out = []
    for text in texts:
        w, hit, owners = WORD.findall((text or "").translate(LOW)), set(), set()
        for k in {len(x) for x in known}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in known:
                    hit.update(range(j, j + k))
                    owners |= known[tuple(w[j : j + k])]
        ids = sorted(str(o) for o in owners if o is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("shard_words", [7, 100_000])
@pytest.mark.parametrize("window", [3, 5])
def test_decontamination_equals_brute_force(spark, window, shard_words):
    rng = random.Random(window)
    line = lambda n: " ".join(rng.choice(["a", "B", "c,", "d-e", "é"]) for _ in range(n))
    items = [(n, line(rng.randint(1, 9))) for n in range(6)] + [(None, line(6)), (3, line(4)), (9, None), (10, "!?")]
    texts = [line(rng.randint(0, 30)) for _ in range(25)] + [None, "", "..."]
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.hit_counts(decontaminate.mark_contamination(spark, docs, bench, window=window, shard_words=shard_words)).collect()
    assert sorted((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found) == hits(texts, items, window)


def test_removal_cuts_spans_and_drops_what_is_mostly_benchmark(spark):
    docs = spark.createDataFrame([(1, "Keep THIS. one two three; and that"), (2, "one two three"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "One, two three")], "item_id long, text string")
    kept = decontaminate.remove_contamination(decontaminate.mark_contamination(spark, docs, bench)).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: "Keep THIS. ; and that", 3: None}


def test_empty_benchmark_and_documents(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.mark_contamination(spark, odd_documents, bench).where("size(hit_spans) > 0").count() == 0
    assert decontaminate.mark_contamination(spark, no_documents, bench).count() == 0


def test_base_counts(spark, odd_documents):
    trees = boosting.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0), np.zeros(len(quality.FEATURES)))
    for r in quality.judge_quality(odd_documents, trees).collect():
        text = r["text"] or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + j for i, t in enumerate(triples) if triples.count(t) > 1 for j in range(3)} if len(w) < 2000 else None
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        if covered is not None:
            assert r["n_repeat_words"] == len(covered)
            assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_trees_follow_monotone_constraints_and_learn():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.1, 3000) > 0.6).astype(float)
    trees = boosting.fit(x[:2000], y[:2000], np.array([1, 0, -1]))
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    grid = np.repeat(rng.uniform(size=(50, 3)), 40, axis=0)
    for column, sign in ((0, 1), (2, -1)):
        moved = grid.copy()
        moved[:, column] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(trees.margin(moved).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-9).all()


def test_quality_of_labelled_documents(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    judged = quality.judge_quality(docs, quality.fit_quality(docs, labels)).where("not base_failed").join(labels.select("doc_id", "quality"), "doc_id").select("quality", "kept").toPandas()
    assert judged.loc[judged["quality"] == 1, "kept"].mean() > 0.98 and (~judged.loc[judged["quality"] == 0, "kept"]).mean() > 0.8


def test_quality_without_labels(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    trees = quality.fit_quality(odd_documents, labels)
    assert quality.judge_quality(odd_documents, trees).where("kept = base_failed").count() == 0
    assert quality.judge_quality(no_documents, trees).count() == 0


def test_machine_learns_a_pair():
    rng = np.random.default_rng(2)
    rows = [sorted(rng.choice(6, 3, replace=False).tolist()) for _ in range(2500)]
    y = np.array([float(0 in r and 1 in r) for r in rows])
    machine = toxicity.fit_machine(rows[:2000], y[:2000], {n: n for n in range(6)}, epochs=60)
    assert ((machine.probability(rows[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_probability_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine({}, 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    rows = [[], [4], [0, 8], [1, 2, 3, 5, 7], list(range(9))]
    for row, p in zip(rows, machine.probability(rows), strict=True):
        total = 0.3 + sum(machine.weight[i] for i in row)
        total += sum(machine.factor[i] @ machine.factor[j] for n, i in enumerate(row) for j in row[n + 1 :])
        assert p == pytest.approx(1 / (1 + np.exp(-total)))


def test_a_pair_that_tells_only_together(spark):
    """Label 1 if a text holds both of two words or neither: each is as frequent in both classes."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows = []
    for n in range(4000):
        text = rng.sample(words, 20) + ["insultword"] * (n % 4 in (0, 1)) + ["groupword"] * (n % 4 in (0, 2))
        rows.append((n, " ".join(rng.sample(text, len(text))), int(n % 4 in (0, 3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs.where(toxicity.held_out()), machine, predict_at=0.5).select("toxic", "predicted").toPandas()
    assert (scored["toxic"] == scored["predicted"]).mean() > 0.85


def test_repeated_ids_do_not_pass_the_bound(spark):
    docs = spark.createDataFrame([(n % 5, f"text number {n}") for n in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(n % 5, n % 2, n % 2) for n in range(50)], "doc_id long, quality int, toxic int")
    assert toxicity._labelled(docs, labels, 3).count() <= 3
    assert len(quality.fit_quality(docs, labels, max_labelled=3).roots) == 0  # one class: every id has a label 1


def test_items_longer_than_a_shard_are_cut(spark):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 400)}" for _ in range(900)]
    bench = spark.createDataFrame([("long", " ".join(words)), ("short", "w1 w2"), ("long", " ".join(words))], "item_id string, text string")
    pieces = decontaminate.item_pieces(bench, "item_id", "text", 10, 50).collect()
    assert max(r["n"] for r in pieces) <= 50 and len(pieces) > 20
    have = {tuple(bytes(r["words"]).decode().split()[i : i + 10]) for r in pieces for i in range(max(1, r["n"] - 9))}
    assert {tuple(words[i : i + 10]) for i in range(891)} <= have


def test_repeat_words_of_any_vocabulary():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 6, 500)
    words = [b"%d" % i for i in ids]
    assert quality._repeat_words(words, ids, 6) == quality._repeat_words(words, ids, 1 << 22) > 0


def test_toxicity_on_held_out_labels(spark):
    where = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, where, "documents"), read_table(spark, where, "labels")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = toxicity.score_toxicity(known, toxicity.fit_toxicity(known, labels)).join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out()).select("toxic", "predicted").toPandas()
    assert scored.loc[scored["toxic"] == 1, "predicted"].mean() > 0.75 and scored.loc[scored["toxic"] == 0, "predicted"].mean() < 0.01


def test_toxicity_ignores_held_out_and_unusable_labels(spark, odd_documents, no_documents):
    held = odd_documents.where(toxicity.held_out()).select("doc_id").first()["doc_id"]
    labels = spark.createDataFrame([(held, 1, 1), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit_toxicity(odd_documents, labels)
    scores = {round(r["score"], 9) for r in toxicity.score_toxicity(odd_documents, machine).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
    assert toxicity.score_toxicity(no_documents, machine).count() == 0


def test_small_table(spark):
    assert read_table(spark, SMALL, "labels").count() > 0
