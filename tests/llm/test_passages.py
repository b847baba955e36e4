"""Recurring passages against a plain count of every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarnwick.llm import passages
from tarnwick.llm.passages import dedup_passages


def words(text):
    return (text or "").encode().split()


def brute(texts, window):
    split = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(frame):
    return sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in frame.collect())


@pytest.mark.parametrize(("seed", "letters", "window", "anchor"), [(1, "ab", 6, 2), (2, "abcd", 5, 3), (3, "abcdefgh", 9, 4), (4, "a", 7, 2)])
def test_random_texts(spark, seed, letters, window, anchor):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(letters) for _ in range(rng.choice([0, 3, window, 12, 40]))) for _ in range(18)]
    texts += [texts[4], "q " * 30, "q r " * 300, None]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    assert rows(dedup_passages(spark, docs, window=window, anchor_words=anchor, keep_text=False, shard_bytes=300)) == brute(texts, window)


def test_odd_documents(spark, odd_documents):
    texts = [r["text"] for r in odd_documents.collect()]
    found = dedup_passages(spark, odd_documents)
    assert rows(found) == brute(texts, 35)
    whole = {r["doc_id"]: r for r in found.where("n_removed = 0").collect()}
    assert all(r["kept_text"] == (r["text"] or "") for r in whole.values())
    assert {"lang", "source", "score"} <= set(found.columns)


def test_the_automaton_decides(spark, odd_documents):
    """What the automaton does not find stays: counting knows no places."""

    class Blind(passages.Phrases):
        def covered(self, words):
            return np.zeros(len(words), bool)

    assert dedup_passages(spark, odd_documents, automaton=Blind).where("n_removed > 0").count() == 0
    assert dedup_passages(spark, odd_documents).where("n_removed > 0").count() > 0
    docs, phrases = pa.table({"text": ["a b c d"]}), pa.table({"words": [b"b c"]})
    assert passages.remove_phrases(docs, phrases, "text", False)[1].to_pylist() == [2]
    assert passages.remove_phrases(docs, phrases.slice(0, 0), "text", False)[1].to_pylist() == [0]


def table_rows(seed, head, filler, rows):
    """A table whose rows share a head and differ in the words after it; its first words; other text."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    start = [word(5) for _ in range(head)]
    whole = [w for _ in range(rows) for w in [*start, *(word(4) for _ in range(filler))]]
    part = whole[: len(whole) // 3] + [word(6) for _ in range(50)]
    return [" ".join(whole), " ".join(part), " ".join(whole), " ".join([word(6) for _ in range(40)] + whole[-len(whole) // 4 :])]


@pytest.mark.parametrize("longest", [256, 10, 3])
@pytest.mark.parametrize("seed", range(4))
def test_rows_of_tables(spark, seed, longest):
    """A document that holds some of the runs of a longer passage loses these."""
    texts = table_rows(seed, 20, 7, 40) + table_rows(seed + 50, 8, 20, 30)
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    assert rows(dedup_passages(spark, docs, keep_text=False, longest_run=longest)) == brute(texts, 35)


def shared_opening(n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    opening = " ".join(word() for _ in range(40))
    bodies = [" ".join(word() for _ in range(60)) for _ in range(n // 2)]
    return [f"{opening} {b}" for b in bodies for _ in range(2)]


def test_what_is_sent_grows_with_the_input(spark):
    """A shared opening and bodies met twice: an anchor of many phrases does not send all of them to all its shards."""
    counts = []
    for n in (200, 400, 800):
        rows_of = [(k, k % (n // 7), t) for k, t in enumerate(shared_opening(n))]
        frame = spark.createDataFrame(rows_of, "row long, shard int, text string")
        phrases, places = passages.confirmed(spark, frame, 35, 8)
        sent, held = passages.sent_to_shards(phrases, places), passages.emit_runs(frame, 35, 8).count()
        assert sent.count() <= held
        counts.append(sent.count())
    assert counts[1] < 2.4 * counts[0] and counts[2] < 2.4 * counts[1]


def test_any_number_of_different_words():
    many = [[b"%d" % n, b"%d" % (n + 1)] for n in range(0, 1_300_000, 2)]
    found = passages.Phrases(many)
    assert found.covered([b"x", b"1200000", b"1200001", b"1200000", b"7", b"6", b"7"]).tolist() == [False, True, True, False, False, True, True]


def test_no_documents(spark, no_documents):
    assert dedup_passages(spark, no_documents).count() == 0
