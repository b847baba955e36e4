"""The whole pipeline against plain Python, row by row."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from helpers import SMALL

import corpus_pipeline
from tarnwick.llm import quality
from tarnwick.tables import read_table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def walk(trees, x):
    total = trees.base
    for node in trees.roots:
        while trees.feature[node] >= 0:
            node = trees.left[node] if x[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        total += trees.value[node]
    return 1 / (1 + np.exp(-total))


def without_passages(texts, window=35):
    split = [t.encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for text, w in zip(texts, split, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else text)
    return out


def without_benchmark(text, known, window=10):
    words = [(m.group(), m.span()) for m in WORD.finditer(text.translate(LOW))]
    hit = set()
    for k in {len(x) for x in known}:
        for i in range(len(words) - k + 1):
            if tuple(w for w, _ in words[i : i + k]) in known:
                hit.update(range(i, i + k))
    if 2 * len(hit) > len(words):
        return None
    out, done = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(text[done : words[i][1][0]])
        if i + 1 not in hit:
            done = words[i][1][1]
    return "".join([*out, text[done:]])


def grams(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def groups(sets):
    """Position of the first set of each component of sets alike by 0.8 or more."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(n) for n in range(len(sets))]


def test_pipeline_equals_plain_python(spark):
    docs, labels = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "labels")
    trees = quality.fit_quality(docs, labels)
    left = []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        counts, features = quality.statistics([(r["text"] or "").encode()])
        if counts[0][0] >= 50 and 2 * counts[0][4] <= counts[0][0] and walk(trees, features[0]) >= 0.35:
            left.append((r["doc_id"], r["text"]))
    label = groups([grams(t) for _, t in left])
    left = [d for n, d in enumerate(left) if label[n] == n]
    left = list(zip([i for i, _ in left], without_passages([t for _, t in left]), strict=True))
    known = set()
    for r in read_table(spark, SMALL, "benchmark").collect():
        w = WORD.findall(r["text"].translate(LOW))
        known |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)} if w else set()
    left = [(i, cut) for i, t in left if (cut := without_benchmark(t, known)) is not None]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = {i: (t, len(t), hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest()) for i, t in left}
    found = {r["doc_id"]: (r["text"], r["n_chars"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert found == wanted
