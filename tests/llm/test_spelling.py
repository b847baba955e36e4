"""Spelling variants against comparing every word with every word."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnwick.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plainly(rows, least=7, count=2, ratio=10, slip=31):
    total = Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                total[word] += 1
    words = {w: n for w, n in total.items() if n >= count}
    forms, out = {}, []
    for w, n in words.items():
        links = [x for x in words if near(w, x)]
        best = min(links, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        out.append([w, n, len(links), forms[w], words.get(forms[w])])
    for row in out:
        root = row[0]
        while forms[root] is not None:
            root = forms[root]
        row.append(root)
    return sorted(map(tuple, out))


def found(frame):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in frame.collect())


def corpus(seed, letters, size, longest):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, longest))) for _ in range(size)]
    words += [w[:3] + rng.choice(letters) + w[3:] for w in words[: size // 3]] + [w[:2] + w[3:] for w in words[: size // 3]]
    line = lambda: " ".join(rng.choice(words[: rng.choice([2, 9, len(words)])]) for _ in range(rng.randint(0, 90)))
    return [(n % 37, line()) for n in range(60)] + [(None, line()), (3, None), (4, ""), (5, "ÀÉ×÷ÿxyz ÀÉ×÷ÿxyz àé×÷ÿxyz " * 3)]


@pytest.mark.parametrize(("seed", "letters", "size", "longest", "most"), [(1, "ab", 300, 9, 40), (2, "eaitnqé", 400, 9, 25), (3, "eaintorslu", 300, 11, 10_000), (4, "a", 40, 60, 3), (5, "qx", 200, 10, 5)])
def test_random_words(spark, seed, letters, size, longest, most):
    rows = corpus(seed, letters, size, longest)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(spelling.group_spellings(spark, docs, most_words=most)) == plainly(rows)


def test_forms_are_followed_to_the_last(spark):
    text = "colourful " * 2 + "colorful " * 40 + "colorfull " * 900 + "kolorfull " * 12_000 + "kolorfulle " * 1_100
    rows = [(n, text) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = found(spelling.group_spellings(spark, docs, slip=1 << 40))
    assert done == plainly(rows, slip=1 << 40)
    assert {w: root for w, *_, root in done}["colourful"] == "kolorfull"


@pytest.mark.parametrize("scanned", [0, 5, 10_000])
def test_leaves_of_any_size(monkeypatch, scanned):
    """Scanning and looking up give the same pairs, each once."""
    monkeypatch.setattr(spelling, "_SCANNED", scanned)
    monkeypatch.setattr(spelling, "_STEP", 64)
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("qxe") for _ in range(rng.randint(5, 8))) for _ in range(500)} | {"q" * n for n in (39, 40, 41, 42, 254, 255, 256, 257)})
    pairs = [tuple(sorted((words[i], words[j]))) for a, b in spelling.search(words, words, np.zeros(len(words), np.int64), 0) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(pairs) == sorted((a, b) for n, a in enumerate(words) for b in words[n + 1 :] if near(a, b))


def test_only_leaves_within_the_budget_are_verified():
    words = [b"aaaaaaaa", b"aaaaeaaa", b"eeeeaaaa", b"aaaaaaaaa", b"tttttttt"]
    counts = spelling.vectors(words)
    order = np.lexsort(counts.T[::-1])
    trie = spelling.Trie(counts[order])
    met = {(int(q), int(order[trie.leaf[n]])) for query, leaf, _ in trie.reached(counts, np.arange(5), np.zeros(5, np.int64)) for q, n in zip(query, leaf, strict=True)}
    # The fourth word has an a more than the first; the second has an e for an a, and the search spends its surplus on the e.
    assert met == {(n, n) for n in range(5)} | {(0, 1), (0, 3)}


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert found(spelling.group_spellings(spark, odd_documents, min_chars=3)) == plainly(rows, least=3)
    assert spelling.group_spellings(spark, no_documents).count() == 0
