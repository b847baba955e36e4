"""The pipeline's near-dedup stage against brute-force Jaccard over five-word shingles."""

import random

import pytest
from test_pipeline_brute import grams, groups

import corpus_pipeline
from tarnwick.llm import neardup


def brute_kept(rows):
    """doc_ids that stay: the least of each component of pairs with Jaccard >= 0.8."""
    return {rows[n][0] for n, first in enumerate(groups([grams(t) for _, t in rows])) if n == first}


def graded_documents():
    """Copies with 0 to 12 words of 200 replaced (similarity 1 down to about 0.5), chains of them, and short texts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for changed in range(13):
            copy = list(base)
            for n in rng.sample(range(200), changed):
                copy[n] = word()
            texts.append(" ".join(copy))
    common = [word() for _ in range(70)]
    texts += [" ".join(common + [word() for _ in range(n)]) for n in range(5, 60)]  # a shared passage
    texts += ["", "  ", "one two", "One  two", "one two three", "a b c d e f", "a b c d e f g"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_equals_brute_force(spark):
    rows = graded_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == brute_kept(rows)


@pytest.mark.parametrize("chunk_rows", [2, 5])
def test_chunks_miss_no_link(spark, chunk_rows):
    rows = graded_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in neardup.keep_one(spark, docs, chunk_rows=chunk_rows).collect()} == brute_kept(rows)


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_rounds_do_not_matter(spark, rounds):
    rows = graded_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in neardup.keep_one(spark, docs, rounds=rounds).collect()} == brute_kept(rows)


def test_recall_at_the_threshold(spark):
    """Of pairs of texts whose similarity is just above 0.8, at least 0.97 are candidates."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    pairs = []
    while len(pairs) < 500:
        base = [word() for _ in range(300)]
        copy = list(base)
        for n in rng.sample(range(300), 7):
            copy[n] = word()
        a, b = grams(" ".join(base)), grams(" ".join(copy))
        if 0.8 <= len(a & b) / len(a | b) <= 0.83:
            pairs.append((" ".join(base), " ".join(copy)))
    rows = [(2 * n + k, t) for n, p in enumerate(pairs) for k, t in enumerate(p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert neardup.keep_one(spark, docs).count() <= 500 + 15


def test_repeated_rows_keep_the_least_by_all_columns(spark):
    rows = [(1, "one text of five words", "b"), (1, "one text of five words", "a"), (2, "one text of five words", "a"), (None, "other", "x"), (None, "other", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert sorted((tuple(r) for r in neardup.keep_one(spark, docs).collect()), key=str) == [(1, "one text of five words", "a"), (None, "other", "w")]


def test_odd_documents(spark, odd_documents, no_documents):
    rows = sorted({(r["doc_id"], r["text"]) for r in odd_documents.collect()}, key=lambda r: (r[0] is None, r[0] or 0))
    kept = neardup.keep_one(spark, odd_documents)
    assert kept.columns == odd_documents.columns
    assert {r["doc_id"] for r in kept.collect()} == brute_kept(rows)
    assert neardup.keep_one(spark, no_documents).count() == 0
