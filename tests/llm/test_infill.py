"""Fill-in-middle against cutting by a list of units."""

import hashlib
import random
import re

import pytest

from tarnwick.llm import infill

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plainly(doc_id, text, seed=42, fim=50, spm=80, marks=infill.MARKERS):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in marks) or h3 % 100 >= fim:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = marks
    out = f"{s}{suffix}{p}{prefix}{m}{middle}" if h4 % 100 < spm else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return len(units), "spm" if h4 % 100 < spm else "psm", len(prefix), len(middle), out


def compared(frame, **args):
    made = infill.fill_in_middle(frame, **args).withColumn("again", infill.restored())
    for r in made.collect():
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["fim_text"]) == plainly(r["doc_id"], r["text"], fim=args.get("fim_percent", 50), spm=args.get("spm_percent", 80))
        assert r["again"] == (r["text"] or "")
    return made


@pytest.mark.parametrize("block", [1, 3, 64, 1024])
def test_cuts_at_any_block_size(spark, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice(["a", "é", "日", " ", "\n", "\t ", "\x85", "<", "P>", "😀"]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    texts += [" ", "\n\n", "x", " x", "x ", "a <P> b", "<S>", "x<M>", "<", "<S", None]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    made = compared(docs, fim_percent=100, spm_percent=50, block_bytes=block)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_odd_documents(spark, odd_documents, no_documents):
    made = compared(odd_documents)
    assert {"lang", "source", "score", "n_words"} <= set(made.columns) and made.count() == odd_documents.count()
    assert infill.fill_in_middle(no_documents).count() == 0


def test_columns_with_the_name_of_a_result_are_replaced(spark):
    docs = spark.createDataFrame([(3, "a b c", "mine", "kept")], "doc_id long, text string, form string, drawn string")
    row = infill.fill_in_middle(docs).first()
    assert row["form"] in ("plain", "psm", "spm") and row["drawn"] == "kept"


def test_text_beyond_every_slice(spark):
    text = " ".join(f"wörd{n}" for n in range(900_000))
    docs = spark.createDataFrame([(n, text if n == 1 else "s t u") for n in range(3)], "doc_id long, text string")
    compared(docs, fim_percent=100)


def test_tree_finds_every_cut():
    text = "  aé b\n\n日本  c d ".encode()
    tree = infill.BlockTree(text, 4)
    units = UNIT.findall(text.decode())
    assert tree.units == len(units)
    for n in range(len(units) + 1):
        head = "".join(units[:n])
        assert tree.cut(n) == (len(head.encode()), len(head))


def test_markers_must_be_told_apart(spark, odd_documents):
    with pytest.raises(ValueError, match="markers"):
        infill.fill_in_middle(odd_documents, markers=("<a>", "<a>", "<b>"))
