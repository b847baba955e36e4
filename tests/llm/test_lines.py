"""Line dedup against plain counting."""

import random

import pytest

from tarnwick.llm import lines

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def plainly(rows, least=10, documents=2):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(doc)
    keeper = {k: min((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= documents}
    out = []
    for doc, text in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if key(x) not in keeper or keeper[key(x)] == doc]
        out.append((doc, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("seed", "documents"), [(1, 2), (2, 3), (3, 5)])
def test_random_texts(spark, seed, documents):
    rng = random.Random(seed)
    pool = ["", "short", "A line of some length", "a LINE of some length ", "\tanother line, longer\r", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "1234567890", "123456789", "\x85 edges that are no blanks"]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, ""]) if rng.random() < 0.1 else "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for _ in range(40)]
    rows += [rows[3], rows[3], rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(lines.dedup_lines(spark, docs, min_documents=documents)) == plainly(rows, documents=documents)


def test_one_line_in_every_document_and_a_very_long_text(spark):
    rows = [(n, f"the same notice everywhere\nown line number {n}\nthe same notice everywhere") for n in range(300)]
    rows.append((500, "\n".join(f"line number {n % 70_000}" for n in range(140_000))))
    rows.append((501, "\n".join(f"LINE number {n}" for n in range(0, 70_000, 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(lines.dedup_lines(spark, docs)) == plainly(rows)


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    done = lines.dedup_lines(spark, odd_documents)
    assert found(done) == plainly(rows)
    assert {"lang", "source", "n_words", "score"} <= set(done.columns)
    assert lines.dedup_lines(spark, no_documents).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x", 7, "a", "b", 5), (2, "y", 8, "a", "b", 6)], "doc_id long, text string, n_lines long, id string, `drop` string, h1 int")
    done = lines.dedup_lines(spark, docs)
    assert [(r["n_lines"], r["id"], r["drop"]) for r in done.orderBy("doc_id").collect()] == [(1, "a", "b"), (1, "a", "b")]
