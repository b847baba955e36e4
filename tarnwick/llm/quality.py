"""Quality rules: fixed base rules, then gradient-boosted trees over statistics.

Statistics are computed from whole texts inside Arrow batches; no row is
shuffled. The trees are fitted on the driver over at most ``max_labelled`` rows of
``labels`` (those with the smallest hash of doc_id), whose statistics are computed
in the executors; only a row of floats per labelled document reaches the driver.

Edge cases: a null or blank text has no words and fails the base rules. Labelled
rows with a null or an unknown doc_id, or a null label, teach nothing. Without
usable labels of both classes the trees are empty and the verdict is the base
rules' alone. Of several labels of one doc_id the largest counts, of several texts
the least, so no more than max_labelled rows reach the driver. Repeated rows are
judged alike, each for itself. Columns of the input with the name of a result are
replaced. No documents, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm import boosting
from tarnwick.llm.batches import append_columns

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Sign the kept-probability must follow: more of these never makes a text better.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "shouts": -1, "pipes": -1, "digits": 0, "stops": 0, "line_words": 0}
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"
_NOT_WORD_CHARS = _SPACE + bytes(range(0x80, 0xC0))  # blanks and UTF-8 continuation bytes
_UPPER, _ALPHA, _DIGIT = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), b"0123456789"


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def _repeat_words(words: list[bytes], ids: np.ndarray, size: int) -> int:
    if len(words) < 4:
        return 0
    pair = ids[:-1] * size + ids[1:]
    if size >= 1 << 21:  # three ids do not fit into 63 bits: number the pairs instead
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * size + ids[2:]
    _, group, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[group] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : len(words) - 2 + shift] |= twice
    return int(covered.sum())


def statistics(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(counts in the order of COUNTS, features in the order of FEATURES) of each text."""
    counts = np.zeros((len(batch), len(COUNTS)), np.int64)
    features = np.zeros((len(batch), len(FEATURES)))
    for row, text in enumerate(batch):
        words = text.split()
        if not words:
            continue
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        lines = [x for x in text.split(b"\n") if x.strip()]
        n, chars = len(words), len(text.translate(None, _NOT_WORD_CHARS))
        symbols, repeats = _count(text, SYMBOLS), _repeat_words(words, ids, len(seen))
        duplicates = len(lines) - len(set(lines))
        counts[row] = n, chars, symbols, duplicates, repeats
        letters = max(1, _count(text, _ALPHA))
        features[row] = (
            np.log1p(n), chars / n, symbols / n, duplicates / len(lines), repeats / n, _count(text, _UPPER) / letters,
            text.count(b"!") / n, text.count(b"|") / n, _count(text, _DIGIT) / max(1, chars), _count(text, b".,;:?") / n, min(200.0, n / len(lines)),
        )
    return counts, features


def base_failed(counts: np.ndarray, least_words: int = 50, most_repeats: int = 50) -> np.ndarray:
    return (counts[:, 0] < least_words) | (100 * counts[:, 4] > most_repeats * counts[:, 0])


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> boosting.FlatTrees:
    """Fit the trees on labels.quality of at most max_labelled labelled rows."""
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    field = T.StructField("features", T.ArrayType(T.DoubleType()))

    def work(batch: list[bytes]) -> list[pa.Array]:
        return [pa.array(list(statistics(batch)[1]), pa.list_(pa.float64()))]

    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = append_columns(known, "text", [field], work).select("features", "label").toPandas()
    x = np.stack(rows["features"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort(np.column_stack([rows["label"], x]).T) if len(rows) else []
    return boosting.fit(x[order], rows["label"].to_numpy(float)[order], np.array(list(FEATURES.values())))


def judge_quality(docs: DataFrame, trees: boosting.FlatTrees, text: str = "text", keep_at: float = 0.35, least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """docs plus the base counts, base_failed, quality_score (0 to 1) and kept."""

    def work(batch: list[bytes]) -> list[pa.Array]:
        counts, features = statistics(batch)
        failed, score = base_failed(counts, least_words, most_repeats), trees.probability(features)
        return [*map(pa.array, counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_at))]

    fields = [T.StructField(n, T.LongType()) for n in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return append_columns(docs, text, fields, work)
