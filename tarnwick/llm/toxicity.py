"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words, their prefixes of four to seven characters (so that a stem
counts under every ending) and marks that several different words share a prefix,
hashed to 2**22 buckets. The executors count in how many labelled texts of either
class each bucket occurs. The machine's inputs are the ``telling`` buckets that
separate the classes best by themselves (by at least ``least_gain``) and, whatever
their classes, the ``frequent`` words that most texts hold: two words that are only
telling together have equal rates alone. The machine's pairwise factors learn what a
sum of weights misses. Terms of fewer than ``least_texts`` labelled texts are no
inputs: nothing can be learned of them.

Learning uses at most ``max_labelled`` labelled rows (those with the smallest hash
of doc_id) outside the held-out third; that bound also bounds the one broadcast.
What reaches the driver is the table of chosen buckets and, for each labelled
text, the few of them it holds. Scoring maps whole texts, without a shuffle.

Edge cases: null and empty texts hold no term and get the score of the bias. A
labelled row with a null doc_id or label teaches nothing; of several labels of one
doc_id the largest counts, of several texts the least. Without both classes the score
is the share of label 1. Repeated rows score alike. Columns of the input with the name
of a result are replaced, others pass through. No documents, no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick import scratch
from tarnwick.llm.batches import append_columns, slices, texts, tidied
from tarnwick.llm.decontaminate import words_of

BUCKETS = 1 << 22
PREFIXES = (4, 5, 6, 7)
REPEATS = (2, 3, 5)
_MOST_WORDS = 400_000


def terms(word: bytes) -> tuple[int, list[int]]:
    """Bucket of a word (even), and those of its prefixes (odd)."""
    text = word.decode("utf-8", "replace").lower()
    return xxhash.xxh32_intdigest(b"w" + text.encode()) % BUCKETS & ~1, [xxhash.xxh32_intdigest(b"p" + text[:n].encode()) % BUCKETS | 1 for n in PREFIXES if len(text) >= n]


def times(prefix: int, n: int) -> int:
    """Bucket of "n or more different words of the text have this prefix"."""
    return (prefix * 0x9E3779B1 + n * 0x85EBCA6B) % BUCKETS | 1


def terms_of(held: Iterable[tuple[int, list[int]]]) -> set[int]:
    """All buckets of a text from the terms of its different words."""
    found: set[int] = set()
    prefixes: Counter[int] = Counter()
    for word, own in held:
        found.add(word)
        prefixes.update(own)
    return found.union(prefixes, (times(p, n) for p, c in prefixes.items() if c > 1 for n in REPEATS if c >= n))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for a third of all ids; these labels are never learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Machine:
    """Bias, weights and factors of the chosen buckets."""

    index: dict[int, int]
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    _seen: dict[bytes, tuple[list[int], list[int]]] = field(default_factory=dict)

    def inputs(self, text: bytes) -> list[int]:
        """The machine's inputs that a text holds, sorted."""
        seen, words = self._seen, set(words_of(text))
        if len(seen) > _MOST_WORDS:
            seen.clear()
        for w in words.difference(seen):
            word, prefixes = terms(w)
            seen[w] = [self.index[t] for t in {word, *prefixes} if t in self.index], [p for p in prefixes if any(times(p, n) in self.index for n in REPEATS)]
        found: set[int] = set()
        prefixes: Counter[int] = Counter()
        for w in words:
            direct, own = seen[w]
            if direct:
                found.update(direct)
            if own:
                prefixes.update(own)
        found.update(self.index[t] for p, c in prefixes.items() for n in REPEATS if c >= n and (t := times(p, n)) in self.index)
        return sorted(found)

    def probability(self, rows: list[list[int]]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for n, row in enumerate(rows):
            if row:
                v = self.factor[row]
                out[n] += self.weight[row].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def fit_machine(rows: list[list[int]], y: np.ndarray, index: dict[int, int], factors: int = 6, epochs: int = 30, batch: int = 128, rate: float = 0.1, ridge: float = 5e-4, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss."""
    random = np.random.default_rng(seed)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    bias, weight, factor = float(np.log(share / (1 - share))), np.zeros(len(index)), random.normal(0, 0.1, (len(index), factors))
    if not len(index) or not 0 < y.sum() < len(y):
        return Machine({}, bias, weight[:0], factor[:0])
    square_w, square_v, square_b = np.full(len(index), 1e-6), np.full(factor.shape, 1e-6), 1e-6
    sizes = np.array([len(r) for r in rows])
    flat, begin = np.array([i for r in rows for i in r], np.int64), np.concatenate([[0], sizes.cumsum()])
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            row = np.repeat(np.arange(len(some)), sizes[some])
            used, at = np.unique(flat[np.repeat(begin[some] - np.concatenate([[0], sizes[some].cumsum()[:-1]]), sizes[some]) + np.arange(len(row))], return_inverse=True)
            held = np.zeros((len(some), len(used)), np.float32)
            held[row, at] = 1.0
            w, v = weight[used], factor[used]
            total = held @ v
            margin = bias + held @ (w - 0.5 * (v**2).sum(1)) + 0.5 * (total**2).sum(1)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[some]) / len(some)
            pull = g @ held
            grad_w = pull + ridge * w
            grad_v = held.T @ (g[:, None] * total) - pull[:, None] * v + ridge * v
            square_w[used] += grad_w**2
            square_v[used] += grad_v**2
            square_b += g.sum() ** 2
            weight[used] -= 0.3 * rate * grad_w / np.sqrt(square_w[used])
            factor[used] -= 0.5 * rate * grad_v / np.sqrt(square_v[used])
            bias -= 0.3 * rate * g.sum() / np.sqrt(square_b)
    return Machine(index, float(bias), weight, factor)


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(label, text), one row for each of at most max_labelled ids."""
    usable = labels.where(~held_out()).where("doc_id is not null and toxic is not null")
    some = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")


def count_terms(labelled: DataFrame) -> DataFrame:
    """(bucket, ones, zeros): labelled texts of either class that hold the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, list[int]]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                held: tuple[list[int], list[int]] = ([], [])
                for text, label in zip(texts(part.column("text")), part.column("label").to_pylist(), strict=True):
                    words = set(words_of(text))
                    if len(seen) > _MOST_WORDS:
                        seen.clear()
                    for w in words.difference(seen):
                        seen[w] = terms(w)
                    held[label].extend(terms_of([seen[w] for w in words]))
                zeros, ones = (np.unique(np.array(x, np.int64), return_counts=True) for x in held)
                bucket = np.concatenate([ones[0], zeros[0]])
                n1, n0 = np.concatenate([ones[1], 0 * zeros[1]]), np.concatenate([0 * ones[1], zeros[1]])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (bucket, n1, n0)], names=["bucket", "ones", "zeros"])

    return labelled.mapInArrow(tidied(run), "bucket long, ones long, zeros long").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def choose_inputs(labelled: DataFrame, telling: int, frequent: int, least_texts: int, least_gain: float) -> dict[int, int]:
    """bucket -> number of the input."""
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate_1, rate_0 = F.col("ones") / float(max(1, totals.get(1, 0))), F.col("zeros") / float(max(1, totals.get(0, 0)))
    gain = F.abs(rate_1 - rate_0) * F.abs(F.log((rate_1 + 1e-3) / (rate_0 + 1e-3)))
    counted = scratch.table(labelled.sparkSession, count_terms(labelled).where(F.col("ones") + F.col("zeros") >= least_texts), "terms")
    best = counted.withColumn("gain", gain).where(F.col("gain") > least_gain).orderBy(F.desc("gain"), "bucket").limit(telling)
    often = counted.where("bucket % 2 = 0").orderBy(F.desc(F.col("ones") + F.col("zeros")), "bucket").limit(frequent)
    return {b: n for n, b in enumerate(sorted({r["bucket"] for part in (best, often) for r in part.select("bucket").collect()}))}


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, telling: int = 4096, frequent: int = 1024, least_texts: int = 3, least_gain: float = 0.002) -> Machine:
    """Learn labels.toxic of at most max_labelled rows that are not held out."""
    labelled = scratch.table(docs.sparkSession, _labelled(docs, labels, max_labelled), "labelled")
    index = choose_inputs(labelled, telling, frequent, least_texts, least_gain)
    chooser = Machine(index, 0.0, np.zeros(0), np.zeros((0, 0)))

    def work(batch: list[bytes]) -> list[pa.Array]:
        return [pa.array([chooser.inputs(t) for t in batch], pa.list_(pa.int32()))]

    found = append_columns(labelled, "text", [T.StructField("inputs", T.ArrayType(T.IntegerType()))], work).select("label", "inputs").collect()
    rows = sorted((r["label"], r["inputs"]) for r in found)
    return fit_machine([inputs for _, inputs in rows], np.array([label for label, _ in rows], float), index)


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text", predict_at: float = 0.7) -> DataFrame:
    """docs plus score (0 to 1) and predicted."""

    def work(batch: list[bytes]) -> list[pa.Array]:
        score = machine.probability([machine.inputs(t) for t in batch])
        return [pa.array(score), pa.array((score >= predict_at).astype(np.int32))]

    return append_columns(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], work)
