"""Substring dedup: recurring passages, located by sharded phrase automata.

A window is ``window`` consecutive words. A word is removed if a window covers it
whose word sequence starts anywhere else, in the same document or in another one.

1. Phrases are confirmed by counting. Every window has an anchor: its
   ``anchor_words``-gram of least hash. Equal windows have equal anchors, so only
   anchors that recur matter; about one word in fifteen starts a new one. Consecutive
   windows of one anchor form a run. A run that recurs as a whole is a phrase. Where
   an anchor recurs but the run does not (passage edges, edited copies) the windows of
   its distinct runs are counted one by one, and stretches of recurring ones inside a
   run are phrases. Both are counts by (anchor hash, content hash), 128 bits together,
   combined map-side, so a passage in a third of all documents stays cheap. Counting
   keeps one carrier of each distinct run, from which the words of its phrases are
   read; it does not know where else a phrase occurs.
2. Documents are dealt into shards of about ``shard_bytes``. Every recurring window of
   a run is inside a phrase of that run, so a shard gets the phrases of the runs that
   its documents hold, by (anchor, run), and no others: what is sent grows with the
   runs, which grow with the text. Shards compile their distinct phrases into an
   Aho-Corasick automaton over words with pyahocorasick, and all documents of the
   shard stream through it; the automaton alone decides what is removed.

Words become two letters each of an alphabet as large as the root of the shard's
vocabulary, since a node of the automaton looks for its child one by one; any number
of different words has letters.

Edge cases: null, empty and blank texts have no words and lose none; texts shorter
than a window lose none; a repeated row makes every window of its text recur.
Columns of the input with the name of a result are replaced, others pass through. No
documents, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick import scratch
from tarnwick.llm.batches import leave, slices, texts, tidied

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM_BASE = np.uint64(0xD1B54A32D192ED03)
#: Bytes of text that one step of counting holds.
_SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Random values of the bytes, so that words that differ in one byte differ in many bits.
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 64, 256, np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; those of a usual step are kept."""
    if n > 2 * _SLICE_BYTES or not _powers:
        size = max(n, 2 * _SLICE_BYTES)
        found = []
        for base in (_BASE, _INVERSE):
            grown = np.full(size, base)
            grown[0] = 1
            found.append(np.multiply.accumulate(grown))
        if n > 2 * _SLICE_BYTES:
            return found[0], found[1]
        _powers[0] = found[0], found[1]
    return _powers[0]


def hashed_words(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the hash of each word, from the bytes as they stand: no word becomes an object."""
    if not batch:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join([*batch, b""]), np.uint8)
    space = _SPACE[raw]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))  # every text is followed by a blank
    power, inverse = powers(len(raw))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=prefix[1:])
    hashes = _mix((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    sizes = np.fromiter(map(len, batch), np.int64, len(batch))
    edges = np.concatenate([[0], (sizes + 1).cumsum()])
    return np.diff(np.searchsorted(begin, edges)), hashes


class Sequence:
    """Word hashes of a slice of documents, laid end to end."""

    def __init__(self, batch: list[bytes]) -> None:
        self.sizes, self.hashes = hashed_words(batch)
        self.begin = np.concatenate([[0], self.sizes.cumsum()])
        n = len(self.hashes)
        power, self.inverse = powers(n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * power[:n], out=self.prefix[1:])

    def content(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words begin..end."""
        return _mix((self.prefix[end] - self.prefix[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.hashes) - k + 1
        total = np.zeros(max(0, n), np.uint64)
        for j in range(k):
            total = total * _GRAM_BASE + self.hashes[j : j + n]
        return _mix(total)


def runs(seq: Sequence, window: int, anchor_words: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash, anchor repeats inside) of each run, in words of the slice.

    A run is a stretch of windows of one document with one least hash, cut at longest windows.
    """
    none = np.empty(0, np.int64)
    reach, n = window - anchor_words + 1, len(seq.hashes) - window + 1
    if n < 1:
        return none, none, np.empty(0, np.uint64), np.empty(0, bool)
    gram = seq.grams(anchor_words)
    value, span = gram, 1  # least of the next span grams, which doubles up to the grams of a window
    while span < reach:
        step = min(span, reach - span)
        value = np.minimum(value[: len(value) - step], value[step:])
        span += step
    doc = np.repeat(np.arange(len(seq.sizes)), seq.sizes)
    inside = doc[:n] == doc[window - 1 : window - 1 + n]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (value[1:] != value[:-1]) | (doc[1:n] != doc[: n - 1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return none, none, np.empty(0, np.uint64), np.empty(0, bool)
    held = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    new |= inside & ((np.arange(n) - held) % longest == 0)
    first = np.flatnonzero(new)
    count = np.bincount((np.cumsum(new) - 1)[inside], minlength=len(first))
    view = np.lib.stride_tricks.sliding_window_view(gram, reach)[first]
    place = first + (view == value[first][:, None]).argmax(axis=1)
    return first, count, value[first], place < first + count - 1


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def emit_runs(rows: DataFrame, window: int, anchor_words: int, longest: int = 256) -> DataFrame:
    """(anchor, run, row, shard, first, windows, inside) of every run; first counts words of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                seq = Sequence(texts(part.column("text")))
                first, count, anchor, inside = runs(seq, window, anchor_words, longest)
                doc = np.searchsorted(seq.begin, first, "right") - 1
                content = seq.content(first, first + count + window - 1) if len(first) else np.empty(0, np.uint64)
                row, shard = (part.column(n).to_numpy(zero_copy_only=False)[doc] for n in ("row", "shard"))
                columns = [_longs(anchor), _longs(content), pa.array(row), pa.array(shard), pa.array((first - seq.begin[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(inside)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "run", "row", "shard", "first", "windows", "inside"])

    return rows.mapInArrow(tidied(run), "anchor long, run long, row long, shard int, first int, windows int, inside boolean")


def _windows_of(part: pa.RecordBatch, window: int) -> tuple[Sequence, np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Of carriers (text, runs): their words, and for each window its document, the fields of its run and its first word."""
    seq = Sequence(texts(part.column("text")))
    lists = part.column("runs")
    flat = pa.RecordBatch.from_struct_array(lists.flatten())
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    count = flat.column("windows").to_numpy(zero_copy_only=False)
    each = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(each)) - np.repeat(count.cumsum() - count, count)
    fields = {n: flat.column(n).to_numpy(zero_copy_only=False)[each] for n in flat.schema.names}
    return seq, doc[each], fields, fields["first"].astype(np.int64) + step


def count_windows(carriers: DataFrame, window: int) -> DataFrame:
    """(anchor, run, content, weight, row, first, part) of each window, of carriers (row, text, runs: anchor, run, first, windows, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                seq, doc, fields, first = _windows_of(part, window)
                at = seq.begin[doc] + first
                content = seq.content(at, at + window) if len(at) else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(fields["anchor"], pa.int64()), pa.array(fields["run"], pa.int64()), _longs(content), pa.array(fields["weight"], pa.int64()), pa.array(part.column("row").to_numpy(zero_copy_only=False)[doc]), pa.array(first.astype(np.int32)), pa.array(fields["weight"] == 1)], names=["anchor", "run", "content", "weight", "row", "first", "part"])

    return carriers.mapInArrow(tidied(run), "anchor long, run long, content long, weight long, row long, first int, part boolean")


def phrase_words(carriers: DataFrame, window: int) -> DataFrame:
    """(anchor, run, words) of carriers (row, text, runs: anchor, run, first, windows): the words of each stretch.

    Windows of one run that follow on are one stretch; runs are never joined with one
    another, as a document may hold one of them alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                anchors, runs_of, words = [], [], []
                for text, stretches in zip(texts(part.column("text")), part.column("runs").to_pylist(), strict=True):
                    split = text.split()
                    merged: dict[tuple[int, int], list[list[int]]] = {}
                    for s in sorted(stretches, key=lambda s: s["first"]):
                        own = merged.setdefault((s["anchor"], s["run"]), [])
                        if own and own[-1][1] >= s["first"]:
                            own[-1][1] = max(own[-1][1], s["first"] + s["windows"])
                        else:
                            own.append([s["first"], s["first"] + s["windows"]])
                    for (anchor, of_run), spans in merged.items():
                        for begin, end in spans:
                            anchors.append(anchor)
                            runs_of.append(of_run)
                            words.append(b" ".join(split[begin : end + window - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(runs_of, pa.int64()), pa.array(words, pa.binary())], names=["anchor", "run", "words"])

    return carriers.mapInArrow(tidied(run), "anchor long, run long, words binary")


def confirmed(spark: SparkSession, rows: DataFrame, window: int, anchor_words: int, longest: int = 256) -> tuple[DataFrame, DataFrame]:
    """(anchor, run, words) of every phrase, and (shard, anchor, run): the shards in which a run of a recurring anchor occurs."""
    every = scratch.table(spark, emit_runs(rows, window, anchor_words, longest), "runs")
    met = F.sum(F.when(F.col("inside"), 2).otherwise(1))
    again = every.groupBy("anchor").agg(met.alias("times")).where("times > 1").select("anchor")
    some = scratch.table(spark, every.join(scratch.table(spark, again, "anchors"), "anchor", "left_semi"), "recurring-runs")
    scratch.drop(spark, every)
    by_run = scratch.table(spark, some.groupBy("anchor", "run").agg(F.count("*").alias("times"), F.max("inside").alias("inside"), F.min(F.struct("row", "first", "windows")).alias("at")), "distinct-runs")
    mixed = by_run.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("fewest"), F.max("inside").alias("inside")).where("(kinds > 1 or inside) and fewest = 1").select("anchor")
    edges = by_run.join(scratch.table(spark, mixed, "mixed-anchors"), "anchor", "left_semi").select("at.row", F.struct("anchor", "run", "at.first", "at.windows", F.least("times", F.lit(2)).alias("weight")).alias("edge"))
    carriers = rows.select("row", "text").join(edges.groupBy("row").agg(F.collect_list("edge").alias("runs")), "row")
    windows = scratch.table(spark, count_windows(carriers, window), "windows")
    twice = windows.groupBy("anchor", "content").agg(F.sum("weight").alias("n")).where("n > 1")
    # Of a run that is met once, the windows that recur; of one that recurs, all.
    part = windows.where("part").join(scratch.table(spark, twice.select("anchor", "content"), "recurring-windows"), ["anchor", "content"], "left_semi").select("row", F.struct("anchor", "run", "first", F.lit(1).alias("windows")).alias("stretch"))
    whole = by_run.where("times > 1").select("at.row", F.struct("anchor", "run", "at.first", "at.windows").alias("stretch"))
    stretches = whole.unionAll(part).groupBy("row").agg(F.collect_list("stretch").alias("runs"))
    phrases = phrase_words(rows.select("row", "text").join(stretches, "row"), window)
    return scratch.table(spark, phrases, "phrases"), some.select("shard", "anchor", "run").distinct()


def sent_to_shards(phrases: DataFrame, places: DataFrame) -> DataFrame:
    """(shard, words): each shard's phrases, at most those of the runs that it holds."""
    return places.join(phrases, ["anchor", "run"]).select(F.col("shard").alias("__shard"), "words")


class Phrases:
    """Aho-Corasick automaton over words, two letters each, for the phrases of one shard of documents."""

    def __init__(self, phrases: list[list[bytes]]) -> None:
        vocabulary = list({w for words in phrases for w in words})
        base = max(2, int(np.ceil(np.sqrt(len(vocabulary)))))
        letter = [chr(n if n < 0xD800 else n + 0x800) for n in range(1, 2 * base + 1)]
        self.code = {w: letter[n // base] + letter[base + n % base] for n, w in enumerate(vocabulary)}
        self.automaton = ahocorasick.Automaton()
        for words in phrases:
            self.automaton.add_word("".join(map(self.code.__getitem__, words)), len(words))
        if phrases:
            self.automaton.make_automaton()

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Mask of the words that an occurrence of a phrase covers."""
        edge = np.zeros(len(words) + 1, np.int64)
        if self.code:
            get = self.code.get
            for end, size in self.automaton.iter("".join([get(w, "\0\0") for w in words])):
                edge[end // 2 + 1 - size] += 1
                edge[end // 2 + 1] -= 1
        return edge[:-1].cumsum() > 0


def remove_phrases(docs: pa.Table, phrases: pa.Table, text: str, keep_text: bool, automaton: type[Phrases] = Phrases) -> list[pa.Array]:
    """n_words, n_removed, kept_sha256 and, on demand, kept_text of the documents of one shard."""
    found = automaton([w.split(b" ") for w in set(phrases.column("words").to_pylist())])
    n_words, n_removed, digests, texts_left = [], [], [], []
    for whole in texts(docs.column(text)):
        words = whole.split()
        gone = found.covered(words)
        removed = int(gone.sum())
        left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words)
        n_words.append(len(words))
        n_removed.append(removed)
        digests.append(hashlib.sha256(left).hexdigest())
        texts_left.append(left if removed else whole)
    columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
    return [*columns, pa.array(texts_left, pa.binary()).cast(pa.string())] if keep_text else columns


def dedup_passages(spark: SparkSession, docs: DataFrame, text: str = "text", window: int = 35, anchor_words: int = 8, keep_text: bool = True, shard_bytes: int = 1 << 19, longest_run: int = 256, automaton: type[Phrases] = Phrases) -> DataFrame:
    """docs plus n_words, n_removed, kept_sha256 and, on demand, kept_text; without it, text is left out too.

    Kept words are joined by single blanks; kept_text is the original text where nothing
    is removed, and the empty one for a null. Runs are
    cut at longest_run windows; automaton finds the phrases of a shard.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept_text", T.StringType())] * keep_text
    named = docs.drop("n_words", "n_removed", "kept_sha256", "kept_text")
    names = named.columns
    kept = [f for f in named.schema.fields if keep_text or f.name != text]
    # Written once, so that a row keeps its shard whatever is computed again.
    dealt = scratch.table(spark, named.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc")), "texts")
    size = dealt.agg(F.sum(F.octet_length(F.col(f"__doc.`{text}`")))).first()[0] or 0
    shard = F.pmod(F.xxhash64("__row"), F.lit(max(1, -(-size // shard_bytes)))).cast("int")
    rows = dealt.select(F.col("__row").alias("row"), shard.alias("shard"), F.coalesce(F.col(f"__doc.`{text}`"), F.lit("")).alias("text"))
    phrases, places = confirmed(spark, rows, window, anchor_words, longest_run)
    sent = sent_to_shards(phrases, places)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs_here = left.select([f"c{n}" for n in range(len(names))]).rename_columns(names)
        columns = remove_phrases(docs_here, right, text, keep_text, automaton)
        leave()
        return pa.Table.from_arrays([docs_here.column(f.name).combine_chunks() for f in kept] + columns, names=[f.name for f in kept + fields])

    whole = dealt.select(shard.alias("__shard"), *[F.col(f"__doc.`{c}`").alias(f"c{n}") for n, c in enumerate(names)])
    return whole.groupBy("__shard").cogroup(sent.groupBy("__shard")).applyInArrow(run, T.StructType(kept + fields))
