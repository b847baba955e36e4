"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

1. Words are counted over whole texts, per task first and then map-side by Spark.
2. A word's vector holds how many of its letters are in each of ``GROUPS``, in order. A
   trie arranges words by these counts, one group a level. One edit changes a vector
   by one surplus (a letter inserted), one deficit (deleted), one of each (replaced by
   a letter of another group) or not at all (replaced within the group). A search goes
   down the trie depth first with a budget of one surplus and one deficit, so every
   leaf it reaches is at most that far off; the words of the leaf are then verified
   letter by letter. A pair is looked for from one side only: a deficit may be spent
   after a surplus, never before, and words of one vector are taken in order.
3. The trie is spread over shards. Nodes above ``most_words`` words (or one 2048th of
   all, so that the driver holds at most 2048 nodes a level) form its top, which every
   task has; each node below the top is a shard. A word is one row of the shard it is
   stored in, and one row of each shard its search reaches from the top, with the
   budget left there. Shards are searched apart.
4. Links are counted by word, map-side first. The likeliest form of a word is its most
   frequent neighbour, if that is at least ``ratio`` times as frequent; as frequencies
   grow along forms, a word reaches its root by jumps that double, in written tables.

A search holds a bounded number of open branches: the deepest are gone on with first,
``_STEP`` at a time. In a leaf of more than ``_SCANNED`` words, words are looked up by
what is left of them without one letter, so no leaf is compared all with all. Only a
shard of words that share one whole vector can be above ``most_words``; its words are
dealt into parts and its searches are sent to each of these.

Edge cases: null and empty texts have no words; a null id counts as the empty one.
Repeated rows count again. Ties of frequency go to the least word in code-point order.
Other columns are not read. No documents, no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import scratch
from tarnwick.llm.batches import LOWER, leave, slices, texts, tidied

#: Levels of the trie; letters that no group names are the last level's.
GROUPS = ("e", "a", "i", "n", "t", "o", "r", "s", "l", "u", "dk", "cg", "mb", "pv", "hfz")
_LEVELS = len(GROUPS) + 1
_GROUP = np.full(256, _LEVELS - 1, np.uint8)
for _n, _letters in enumerate(GROUPS):
    _GROUP[np.frombuffer(_letters.encode(), np.uint8)] = _n
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Words a task counts before it hands them on.
_MOST_COUNTED = 200_000
#: Open branches that are gone on with at a time, and pairs that are verified at a time.
_STEP = 1 << 16
#: Leaves of more words are searched by lookup.
_SCANNED = 256
#: Longer words are verified one by one.
_LONG = 40
#: What a search has spent: nothing, its surplus, both.
_NONE, _SURPLUS, _BOTH = 0, 1, 2


def word_counts(docs: DataFrame, doc_id: str, text: str, min_chars: int, slip: int) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased; one run in slip of a document has lost a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                for key, body in zip(texts(part.column("id")), texts(part.column("text")), strict=True):
                    salt = zlib.crc32(key + b":")
                    for word, n in Counter(_RUN.findall(body.translate(LOWER).decode())).items():
                        if len(word) < min_chars:
                            continue
                        h = zlib.crc32(word.encode(), salt)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_chars:
                                continue
                        total[word] += n
                if len(total) > _MOST_COUNTED:
                    yield handed()
        yield handed()

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: list[str]) -> list[bytes]:
    """One byte a letter: no letter of a word is beyond the first 256 code points."""
    return [w.encode("latin-1") for w in words]


def vectors(words: list[bytes]) -> np.ndarray:
    """Letters of each group, a row a word; more than 255 count as 255, which keeps differences of one at one or none."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), size)
    group = _GROUP[np.frombuffer(b"".join(words), np.uint8)]
    counts = np.bincount(row * _LEVELS + group, minlength=len(words) * _LEVELS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, _LEVELS)


class Trie:
    """Sorted rows of counts as levels of nodes; the leaves are ranges of rows.

    A node of a level is known by its number; (node, count) of the next level are kept
    sorted in one array, so a child is found by bisection.
    """

    def __init__(self, counts: np.ndarray) -> None:
        """counts: sorted rows, one column a level."""
        self.edges: list[np.ndarray] = []
        node = np.zeros(len(counts), np.int64)
        for column in counts.T:
            edge = node * 256 + column
            new = np.ones(len(edge), bool)
            new[1:] = edge[1:] != edge[:-1]
            self.edges.append(edge[new])
            node = np.cumsum(new) - 1
        n = int(node[-1]) + 1 if len(node) else 0
        self.leaf = np.searchsorted(node, np.arange(n + 1))

    def reached(self, counts: np.ndarray, query: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, leaf, spent) in pieces: the leaves within the budget that each query has left. counts: its rows."""
        depth = len(self.edges)
        stack = [(0, query[k : k + _STEP], np.zeros(len(query[k : k + _STEP]), np.int64), spent[k : k + _STEP]) for k in range(0, len(query), _STEP)]
        while stack:
            level, query, node, spent = stack.pop()
            if level == depth:
                yield query, node, spent
                continue
            edges, own = self.edges[level], counts[query, level].astype(np.int64)
            found = []
            for step, may, then in ((0, None, 0), (1, spent == _NONE, 1), (-1, (spent == _SURPLUS) & (own > 0), 1)):
                some = np.arange(len(query)) if may is None else np.flatnonzero(may & (own + step < 256))
                edge = node[some] * 256 + own[some] + step
                child = np.searchsorted(edges, edge)
                hit = np.flatnonzero(child < len(edges))
                hit = hit[edges[child[hit]] == edge[hit]]
                found.append((query[some[hit]], child[hit], spent[some[hit]] + then))
            query, node, spent = (np.concatenate(x) for x in zip(*found, strict=True))
            stack += [(level + 1, query[k : k + _STEP], node[k : k + _STEP], spent[k : k + _STEP]) for k in range(0, len(query), _STEP)]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    lo, hi = 0, len(a)  # the first place at which they differ
    while lo < hi:
        mid = (lo + hi) // 2
        if a[lo : mid + 1] == b[lo : mid + 1]:
            lo = mid + 1
        else:
            hi = mid
    return a[lo + (len(a) == len(b)) :] == b[lo + 1 :]


class Letters:
    """Words as left-aligned and right-aligned rows of bytes, so that pairs are compared in bulk."""

    def __init__(self, words: list[bytes]) -> None:
        self.words, n = words, len(words)
        self.size = np.fromiter(map(len, words), np.int64, n)
        self.width = int(min(_LONG, self.size.max(initial=1)))
        self.long = self.size > self.width
        flat = b"".join(w.ljust(self.width, b"\0") if len(w) <= self.width else b"\0" * self.width for w in words)
        self.left = np.frombuffer(flat, np.uint8).reshape(n, self.width)
        flat = b"".join(w.rjust(self.width, b"\0") if len(w) <= self.width else b"\0" * self.width for w in words)
        self.right = np.frombuffer(flat, np.uint8).reshape(n, self.width)


def verified(ours: Letters, a: np.ndarray, theirs: Letters, b: np.ndarray) -> np.ndarray:
    """Mask of the pairs (ours[a], theirs[b]) that are one edit apart."""
    if not len(a):
        return np.zeros(0, bool)
    n, m = ours.size[a], theirs.size[b]
    width = min(ours.width, theirs.width)
    # Equal letters from the left, and from the right, must add up to the shorter word, or to all but one of equal lengths.
    head = ours.left[a, :width] != theirs.left[b, :width]
    head = np.where(head.any(axis=1), head.argmax(axis=1), width)
    tail = (ours.right[a, ours.width - width :] != theirs.right[b, theirs.width - width :])[:, ::-1]
    tail = np.where(tail.any(axis=1), tail.argmax(axis=1), width)
    shorter = np.minimum(n, m)
    near = (n != m) & (np.abs(n - m) == 1) & (np.minimum(head, shorter) + np.minimum(tail, shorter) >= shorter)
    near |= (n == m) & (head + tail == n - 1)
    for k in np.flatnonzero(ours.long[a] | theirs.long[b]):
        near[k] = one_edit(ours.words[a[k]], theirs.words[b[k]])
    return near


class Cut:
    """Words by what is left of them without one letter."""

    def __init__(self, words: list[bytes], rows: range) -> None:
        self.whole: dict[bytes, int] = {words[r]: r for r in rows}
        self.without: dict[tuple[int, bytes], list[int]] = {}
        for r in rows:
            for i in range(len(words[r])):
                self.without.setdefault((i, words[r][:i] + words[r][i + 1 :]), []).append(r)

    def near(self, word: bytes) -> set[int]:
        out = set()
        for i in range(len(word)):
            rest = word[:i] + word[i + 1 :]
            out.update(self.without.get((i, rest), ()))
            if rest in self.whole:
                out.add(self.whole[rest])
        for i in range(len(word) + 1):
            out.update(self.without.get((i, word), ()))
        out.discard(self.whole.get(word, -1))
        return out


def search(stored: list[str], asked: list[str], spent: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asked, stored) rows of the pairs one edit apart. All stored words share the counts of the first depth levels."""
    if not stored or not asked:
        return
    words = _letters(stored)
    counts = vectors(words)
    order = np.lexsort(counts.T[::-1])
    words = [words[k] for k in order]
    trie, ours, theirs = Trie(counts[order][:, depth:]), Letters(_letters(asked)), Letters(words)
    cuts: dict[int, Cut] = {}
    for query, leaf, state in trie.reached(vectors(ours.words)[:, depth:], np.arange(len(asked)), spent):
        begin, size = trie.leaf[leaf], trie.leaf[leaf + 1] - trie.leaf[leaf]
        small = size <= _SCANNED
        done = 0
        q, s, first, n = query[small], state[small], begin[small], size[small]
        ends = n.cumsum()
        while done < len(q):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _STEP, "right")))
            many = n[done:upto]
            a = np.repeat(q[done:upto], many)
            b = np.repeat(first[done:upto] - (many.cumsum() - many), many) + np.arange(int(many.sum()))
            near = verified(ours, a, theirs, b)
            a, b, of = a[near], b[near], np.repeat(s[done:upto], many)[near]
            keep = np.fromiter((x != _NONE or ours.words[i] < theirs.words[j] for i, j, x in zip(a.tolist(), b.tolist(), of.tolist(), strict=True)), bool, len(a))
            yield a[keep], order[b[keep]]
            done = upto
        for i, x, k, lo, n in zip(query[~small].tolist(), state[~small].tolist(), leaf[~small].tolist(), begin[~small].tolist(), size[~small].tolist(), strict=True):
            if k not in cuts:
                cuts[k] = Cut(words, range(lo, lo + n))
            near = [j for j in cuts[k].near(ours.words[i]) if x != _NONE or ours.words[i] < words[j]]
            yield np.full(len(near), i), order[np.array(near, np.int64)]


class Top:
    """The nodes of the trie that are above the shards."""

    def __init__(self, inner: dict[bytes, int], most: int) -> None:
        """inner: the words below each node that has more than most."""
        self.inner, self.most = inner, most

    def parts(self, node: bytes) -> int:
        """A node of one whole vector cannot be divided by counts."""
        return -(-self.inner[node] // self.most) if len(node) == _LEVELS and node in self.inner else 1

    def own(self, counts: bytes) -> bytes:
        """The shard that stores a word."""
        return next(counts[:k] for k in range(_LEVELS + 1) if k == _LEVELS or counts[:k] not in self.inner)

    def shards(self, counts: bytes) -> list[tuple[bytes, int]]:
        """(shard, spent) of every shard that the search of a word reaches."""
        out, stack = [], [(b"", _NONE)]
        while stack:
            node, spent = stack.pop()
            if node not in self.inner or len(node) == _LEVELS:
                out.append((node, spent))
                continue
            own = counts[len(node)]
            if spent == _SURPLUS and own > 0:
                stack.append((node + bytes([own - 1]), _BOTH))
            if spent == _NONE and own < 255:
                stack.append((node + bytes([own + 1]), _SURPLUS))
            stack.append((node + bytes([own]), spent))
        return out


def top_of(words: DataFrame, most_words: int) -> Top:
    """The inner nodes of all levels: at most 2048 of them a level, by counting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in vectors(_letters(batch.column("word").to_pylist()))], pa.binary())], names=["counts"])

    most = max(most_words, -(-words.count() // 2048))
    by_vector = words.select("word").mapInArrow(tidied(run), "counts binary").groupBy("counts").agg(F.count("*").alias("n"))
    levels = by_vector.select(F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("level"), "counts", "n").select(F.expr("substring(counts, 1, level)").alias("node"), "n")
    inner = levels.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
    return Top({bytes(r["node"]): r["n"] for r in inner}, most)


def stored_in(words: DataFrame, top: Top) -> DataFrame:
    """(shard, part, word, n): the shard that stores a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("word").to_pylist()
            shards = [top.own(counts.tobytes()) for counts in vectors(_letters(names))]
            parts = [zlib.crc32(word.encode()) % top.parts(shard) for word, shard in zip(names, shards, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.binary()), pa.array(parts, pa.int32()), batch.column("word"), batch.column("n")], names=["shard", "part", "word", "n"])

    return words.mapInArrow(tidied(run), "shard binary, part int, word string, n long")


def asked_of(words: DataFrame, top: Top) -> DataFrame:
    """(shard, part, word, n, spent): a row for each shard that is searched for a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ns = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            rows: list[tuple[bytes, int, str, int, int]] = []
            ways: dict[bytes, list[tuple[bytes, int]]] = {}
            for word, n, counts in zip(names, ns, vectors(_letters(names)), strict=True):
                key = counts.tobytes()
                if key not in ways:
                    ways[key] = top.shards(key)
                rows += [(shard, part, word, n, spent) for shard, spent in ways[key] for part in range(top.parts(shard))]
            for k in range(0, len(rows), _STEP):
                columns = zip(*rows[k : k + _STEP], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int32()), strict=True)], names=["shard", "part", "word", "n", "spent"])

    return words.mapInArrow(tidied(run), "shard binary, part int, word string, n long, spent int")


def near_words(words: DataFrame, most_words: int) -> DataFrame:
    """(word, near, near_n): both directions of every link between words (word, n) one edit apart."""
    top = top_of(words, most_words)
    stored, asked = stored_in(words, top), asked_of(words, top)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names, ns = left.column("word").to_pylist(), left.column("n").to_pylist()
        others, ms = right.column("word").to_pylist(), right.column("n").to_pylist()
        spent = right.column("spent").to_numpy().astype(np.int64) if len(right) else np.zeros(0, np.int64)
        depth = len(key[0].as_py())
        pairs = [(i, j) for a, b in search(names, others, spent, depth) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        out = [pa.array([others[i] for i, _ in pairs] + [names[j] for _, j in pairs], pa.string()), pa.array([names[j] for _, j in pairs] + [others[i] for i, _ in pairs], pa.string()), pa.array([ns[j] for _, j in pairs] + [ms[i] for i, _ in pairs], pa.int64())]
        leave()
        return pa.Table.from_arrays(out, names=["word", "near", "near_n"])

    return stored.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(run, "word string, near string, near_n long")


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): forms are followed to the last, each round twice as far."""
    current = scratch.table(spark, forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = scratch.table(spark, current.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(spark, current)
        current = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return current


def group_spellings(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 7, min_count: int = 2, ratio: int = 10, slip: int = 31, most_words: int = 50_000) -> DataFrame:
    """One row a word of at least min_chars letters and min_count occurrences: word, n, n_near, form, form_n, root."""
    words = scratch.table(spark, word_counts(docs, doc_id, text, min_chars, slip).where(F.col("n") >= min_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best")
    links = near_words(words, most_words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    likely = F.col("best").isNotNull() & (-F.col("best.less") >= ratio * F.col("n"))
    grouped = words.join(links, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.word")).alias("form"), F.when(likely, -F.col("best.less")).alias("form_n"))
    held = scratch.table(spark, grouped, "spellings")
    return held.join(roots(spark, held.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
