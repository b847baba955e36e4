"""Benchmark decontamination by a generalised suffix automaton over words.

The test items, normalised to words, are dealt by hash into shards of about
``shard_words`` words. Tasks compile each shard into a generalised suffix automaton
and store it in the shared folder; neither items nor automata pass through the
driver. Documents then stream once through a Python step that takes the shards in
turn for each slice of texts. A worker holds at most ``_HELD`` automata, so its memory
is bounded whatever the benchmark's size. No shuffle of documents, no join, and a
lost executor only recomputes its own splits. The automaton's states of length one
and two (words and word pairs) are first tested for a whole slice at once in numpy;
the walk that tracks the longest matching length visits only stretches of documents
all of whose pairs occur in items, which is where a window can lie.

Edge cases: null and word-less documents have no words, no hits and no items; a
null or word-less item has no windows. An item with a null id still marks words
but is neither counted nor listed; equal ids count once. An item longer than a shard
is cut into pieces that overlap by a window less one word. Repeated rows are judged
alike. Columns of the input with the name of a result are replaced, others pass
through. No documents give no rows, no benchmark gives no hits.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick import scratch
from tarnwick.llm.batches import append_columns, caches, texts, tidied
from tarnwick.llm.files import get, put

#: ASCII letters lower-cased; bytes that are neither ASCII alphanumeric nor part of a multi-byte character become blanks.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BITS = 22
#: Automata that a worker holds at a time, and bytes of text that meet each in turn.
_HELD, _SLICE_BYTES = 4, 4 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 0x9E3779B1) ^ (b * 0x85EBCA6B + (b >> 7))) & ((1 << _BITS) - 1)


@dataclass
class Automaton:
    """Generalised suffix automaton of one shard of items."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    owners: dict[int, list[str]] = field(default_factory=dict)  # state of a full window -> item ids
    whole: dict[int, list[tuple[int, str | None]]] = field(default_factory=dict)  # state -> (words, id) of items shorter than a window
    shortest: int = 0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(1 << _BITS, bool))

    def _extend(self, last: int, word: int) -> int:
        step, link, length = self.step, self.link, self.length
        if word in step[last]:
            q = step[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, q, word)
        new = len(step)
        step.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
        return new

    def _clone(self, p: int, q: int, word: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = copy
            p = link[p]
        return copy

    @classmethod
    def build(cls, items: list[tuple[str | None, bytes]], window: int) -> Automaton:
        out = cls(window)
        coded = [(i, [out.vocabulary.setdefault(w, len(out.vocabulary)) for w in words_of(text)]) for i, text in items]
        coded = [(i, words) for i, words in coded if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = out._extend(last, w)
        out.shortest = min([window, *(len(w) for _, w in coded)])
        for item, words in coded:
            if len(words) < window:
                state = 0
                for w in words:
                    state = out.step[state][w]
                out.whole.setdefault(state, []).append((len(words), item))
            for state, size in out.walk(words):
                if size >= window:
                    held = out.owners.setdefault(out.full(state), [])
                    if item is not None and (not held or held[-1] != item):
                        held.append(item)
            at = np.array(words, np.int64)
            out.pairs[_slot(at[:-1], at[1:])] = True
        return out

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and longest matching length after each word."""
        state = size = 0
        for w in words:
            while state and w not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.step[state]:
                state, size = self.step[state][w], size + 1
            yield state, size

    def full(self, state: int) -> int:
        """The suffix state that stands for the last `window` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        known = ids >= 0
        tied = known[:-1] & known[1:] & self.pairs[_slot(ids[:-1], ids[1:])]
        first = np.flatnonzero(known & ~np.concatenate([[False], tied]))
        last = np.flatnonzero(known & ~np.concatenate([tied, [False]]))
        long = last - first + 1 >= self.shortest
        yield from zip(first[long].tolist(), last[long].tolist(), strict=True)

    def matches(self, batch: list[bytes]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """document row -> (covered word ranges, ids of items); rows without a hit are absent."""
        get, ids, starts = self.vocabulary.get, [], []
        for text in batch:
            starts.append(len(ids))
            ids.extend([get(w, -1) for w in words_of(text)])
            ids.append(-1)
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not self.shortest or len(ids) < 2:
            return found
        array, edges = np.array(ids, np.int64), np.array(starts)
        for first, last in self.stretches(array):
            row = int(np.searchsorted(edges, first, "right")) - 1
            offset = edges[row]
            for at, (state, size) in enumerate(self.walk(ids[first : last + 1]), first):
                hit = 0
                if size >= self.window:
                    hit, owners = self.window, self.owners[self.full(state)]
                    spans, items = found.setdefault(row, ([], set()))
                    items.update(owners)
                s = state
                while s > 0 and self.whole:
                    for n, item in self.whole.get(s, ()):
                        if n <= size:
                            hit = max(hit, n)
                            items = found.setdefault(row, ([], set()))[1]
                            if item is not None:
                                items.add(item)
                    s = self.link[s]
                if hit:
                    spans = found[row][0]
                    begin, end = int(at - offset - hit + 1), int(at - offset + 1)
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, end))
        return found


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted([*a, *b]):
        if out and out[-1][1] >= begin:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORDS))]
    out, done = [], 0
    for begin, end in spans:
        out.append(text[done : at[begin][0]])
        done = at[end - 1][1]
    return b"".join([*out, text[done:]])


_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def item_pieces(benchmark: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> DataFrame:
    """(item, n, words) of distinct items: their words, of long items in pieces that hold every window."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null").distinct()
    most = max(shard_words, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, whole in zip(batch.column("item").to_pylist(), texts(batch.column("text")), strict=True):
                words = words_of(whole)
                for lo in range(0, max(1, len(words) - window + 1) if words else 0, most - window + 1):
                    piece = words[lo : lo + most]
                    rows.append((item, len(piece), b" ".join(piece)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["item", "n", "words"])

    return items.mapInArrow(tidied(run), "item string, n long, words binary")


def compile_shards(spark: SparkSession, benchmark: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> list[str]:
    """Automata of the items' shards, stored by the tasks that build them; the names of their files."""
    folder = scratch.new_path(spark, "automata")
    pieces = scratch.table(spark, item_pieces(benchmark, item_id, text, window, shard_words), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    shard = F.pmod(F.xxhash64("item", "words"), F.lit(max(1, -(-total // shard_words))))

    def build(items: pa.Table) -> pa.Table:
        name = f"{folder}/{items.column('shard')[0].as_py():08d}"
        held = sorted(zip(items.column("item").to_pylist(), items.column("words").to_pylist(), strict=True), key=lambda x: (x[0] or "", x[1]))
        put(name, pickle.dumps(Automaton.build(held, window)))
        return pa.table({"name": [name]})

    return sorted(r["name"] for r in pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "name string").collect())


_loaded: dict[str, Automaton] = {}
caches.append(_loaded.clear)


def _automaton(name: str) -> Automaton:
    if name not in _loaded:
        while len(_loaded) >= _HELD:
            del _loaded[next(iter(_loaded))]
        _loaded[name] = pickle.loads(get(name))
    return _loaded[name]


def mark_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = 100_000) -> DataFrame:
    """docs plus n_words, hit_spans (word ranges) and hit_items (sorted ids).

    A word is hit if an occurrence of `window` consecutive words of an item, or of
    a whole item that is shorter, covers it.
    """
    names = compile_shards(spark, benchmark, item_id, item_text, window, shard_words)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]

    def work(batch: list[bytes]) -> list[pa.Array]:
        spans: list[list[tuple[int, int]]] = [[] for _ in batch]
        items: list[set[str]] = [set() for _ in batch]
        for name in names:
            for i, (more, owners) in _automaton(name).matches(batch).items():
                spans[i] = _merged(spans[i], more)
                items[i] |= owners
        packed = [[{"begin": a, "end": b} for a, b in x] for x in spans]
        return [pa.array([len(words_of(t)) for t in batch], pa.int64()), pa.array(packed, _ARROW_SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

    return append_columns(docs, text, fields, work, _SLICE_BYTES)


def hit_counts(marked: DataFrame) -> DataFrame:
    """Marked documents plus n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return marked.withColumns({"n_hit": n_hit, "n_items": F.size("hit_items").cast("long"), "items_sha256": F.sha2(F.array_join("hit_items", ",").cast("binary"), 256), "contaminated": F.size("hit_spans") > 0})


def remove_contamination(marked: DataFrame, text: str = "text", max_coverage: float = 0.5) -> DataFrame:
    """Cut hit spans out of texts; drop documents of which more than max_coverage is hit."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    kept = marked.where(n_hit <= F.lit(max_coverage) * F.col("n_words"))
    names = [f.name for f in kept.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("hit_spans").to_pylist()
            if any(spans):
                column = batch.column(text).cast(pa.binary()).to_pylist()
                column = [_without(t, [(s["begin"], s["end"]) for s in x]) if x else t for t, x in zip(column, spans, strict=True)]
                batch = batch.set_column(names.index(text), text, pa.array(column, pa.binary()).cast(batch.column(text).type))
            yield batch

    return kept.mapInArrow(tidied(run), kept.schema)
