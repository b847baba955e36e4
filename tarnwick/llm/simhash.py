"""SimHash near-duplicates through a sharded forest of vantage-point trees.

Every tree looks at one block of the bits. Two fingerprints that differ in at most
``radius`` bits differ in at most ``reach = radius // blocks`` bits of some block, so
each tree only has to bring together what is within ``reach`` in its own block.

A tree is grown on the driver from a bounded sample of fingerprints (``sample_rows``
with the smallest hash): a node takes the vantage point, of some of its sample, whose
distances spread most, and the median distance as its radius. It has at most as many
nodes as the sample has rows, so what travels with the tasks is bounded. Then all
fingerprints are routed: at a node those farther than the radius go outwards, those
within radius + reach go inwards. By the triangle inequality everything else of a
branch is out of reach and pruned, and only fingerprints at a boundary are copied to
the shard behind it, so two that are within reach meet in a leaf. A leaf is a shard.
Shards of more than ``most_rows`` are routed again by trees on the other bits of the
fingerprint; what is still larger, a dense cloud of near copies, is dealt into chunks
and every pair of chunks becomes a shard.

A shard compares all its pairs in blocks of numpy and returns a spanning forest of
the links, never all pairs. Components over all shards come from star rounds.

Several fingerprints a text (``prints``) make a longer one with more blocks; with a
``reach`` below radius // blocks the forest finds less similar texts by chance, in
one of the many trees. The recall of that is measured where it is used.

Copies collapse before any search: only distinct fingerprints are shuffled.

Edge cases: null, empty and blank texts have fingerprint zero, linked like any
other. A null doc_id is never a component's name unless no other is known; rows are
never merged, so repeated rows give repeated results. Columns beside doc_id and text
do not matter. No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick import scratch
from tarnwick.llm.batches import LOWER, append_columns, tidied
from tarnwick.operators.components import connected_components, with_least

SEED = 42
_ALL = (1 << 64) - 1
#: Points routed, and pairs compared, at a time.
_ROUTED, _PAIRS = 1 << 16, 1 << 18
#: A vantage point of a shard that has more neighbours than this links them at once.
_HUB = 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, words_per_shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; a shorter text is one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    line, k = b" ".join(words), min(words_per_shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    begin = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(begin, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprints(text: bytes, words_per_shingle: int = 4, prints: int = 1) -> list[int]:
    """Signed 64-bit SimHashes of a text's shingles; the first is of the hashes themselves."""
    hashes, out = shingle_hashes(text, words_per_shingle), []
    for n in range(prints):
        own = _mix(hashes + np.uint64(n * 0x9E3779B97F4A7C15 & _ALL)) if n else hashes
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(own), 8192):
            bits = np.unpackbits(own[lo : lo + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(own)).view(">i8")[0]))
    return out


def add_fingerprints(docs: DataFrame, text: str = "text", words_per_shingle: int = 4, prints: int = 1, name: str = "prints") -> DataFrame:
    def work(batch: list[bytes]) -> list[pa.Array]:
        return [pa.array([fingerprints(t, words_per_shingle, prints) for t in batch], pa.list_(pa.int64()))]

    return append_columns(docs, text, [T.StructField(name, T.ArrayType(T.LongType()))], work)


def masks(parts: int, bits: int = _ALL) -> list[int]:
    """Masks that part the set bits of `bits` into disjoint runs."""
    places = [n for n in range(64) if bits >> n & 1]
    runs = [places[len(places) * n // parts : len(places) * (n + 1) // parts] for n in range(parts)]
    return [sum(1 << n for n in run) for run in runs]


@dataclass
class Tree:
    """Vantage-point tree over the bits of one mask; inner[n] < 0 marks a leaf."""

    mask: int
    reach: int
    pivot: list[int]
    radius: list[int]
    inner: list[int]
    outer: list[int]

    @classmethod
    def grow(cls, sample: np.ndarray, mask: int, reach: int, leaf: float) -> Tree:
        """leaf: rows of the sample that a leaf may hold."""
        tree = cls(mask, reach, [], [], [], [])
        values, times = np.unique(sample & np.uint64(mask), return_counts=True)
        todo = [(values, times, None, None)]
        while todo:
            values, times, side, parent = todo.pop()
            at = len(tree.pivot)
            if parent is not None:
                side[parent] = at
            for part, start in ((tree.pivot, 0), (tree.radius, 0), (tree.inner, -1), (tree.outer, -1)):
                part.append(start)
            if len(values) < 2 or times.sum() <= leaf:
                continue
            some = values[np.linspace(0, len(values) - 1, min(8, len(values))).astype(int)]
            spread = np.bitwise_count(some[:, None] ^ values[None, :]).astype(np.int64)
            pick = int((np.average(spread**2, axis=1, weights=times) - np.average(spread, axis=1, weights=times) ** 2).argmax())
            away = spread[pick]
            within = np.bincount(away, times).cumsum()
            radius = int(np.abs(2 * within[: int(away.max())] - times.sum()).argmin())
            tree.pivot[at], tree.radius[at] = int(some[pick]), radius
            near = away <= radius
            if not near.any():
                continue
            todo.append((values[near], times[near], tree.inner, at))
            todo.append((values[~near], times[~near], tree.outer, at))
        return tree

    def route(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions) of all leaves that a value belongs to or reaches."""
        todo, mask = [(0, np.arange(len(values)))], np.uint64(self.mask)
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if self.inner[node] < 0:
                yield node, at
                continue
            away = np.bitwise_count((values[at] ^ np.uint64(self.pivot[node])) & mask)
            todo.append((self.inner[node], at[away <= self.radius[node] + self.reach]))
            todo.append((self.outer[node], at[away > self.radius[node]]))


@dataclass
class Forest:
    """Trees over all blocks of all prints; deep[t] are trees over the other bits of tree t's print."""

    trees: list[Tree]
    blocks: int
    deep: list[list[Tree]]

    @classmethod
    def grow(cls, sample: np.ndarray, rows: int, blocks: int, reach: int, radius: int, leaf_rows: int) -> Forest:
        """sample: fingerprints by prints; rows: how many fingerprints there are."""
        leaf, prints = max(4.0, len(sample) * leaf_rows / max(1, rows)), sample.shape[1]
        trees = [Tree.grow(sample[:, p], m, reach, leaf) for p in range(prints) for m in masks(blocks)]
        exact = prints == 1 and reach >= radius // blocks
        least = max(4.0, len(sample) / 1024)
        deep = [[Tree.grow(sample[:, 0], m, radius // blocks, least) for m in masks(blocks, ~t.mask & _ALL)] if exact else [] for t in trees]
        return cls(trees, blocks, deep)


_SHARDED = "shard long, tree int, node long, prints array<long>"


def _prints(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("prints")
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches large enough for a tree's nodes to meet many of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= _ROUTED:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _sharded_batch(batch: pa.RecordBatch, prints: np.ndarray, shard: np.ndarray, tree: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    width = prints.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(prints[at].ravel().view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(tree, pa.int32()), batch.column("node").take(pa.array(at)), lists], names=["shard", "tree", "node", "prints"])


def routed(points: DataFrame, forest: Forest) -> DataFrame:
    """(node, prints) -> (shard, tree, node, prints): every leaf that a point belongs to or reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches):
            prints = _prints(batch)
            for number, tree in enumerate(forest.trees):
                found = list(tree.route(prints[:, number // forest.blocks]))
                shard = np.concatenate([np.full(len(at), number << 32 | leaf, np.int64) for leaf, at in found])
                yield _sharded_batch(batch, prints, shard, np.full(len(shard), number, np.int32), np.concatenate([at for _, at in found]))

    return points.select("node", "prints").mapInArrow(tidied(run), _SHARDED)


def shard_sizes(points: DataFrame, forest: Forest) -> DataFrame:
    """(shard, n), counted without moving a point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches):
            prints = _prints(batch)
            found = [(number << 32 | leaf, len(at)) for number, tree in enumerate(forest.trees) for leaf, at in tree.route(prints[:, number // forest.blocks])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["shard", "n"])

    return points.select("node", "prints").mapInArrow(tidied(run), "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))


def _deeper(large: DataFrame, forest: Forest) -> DataFrame:
    """Large shards routed again by the trees over the other bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches):
            prints, tree = _prints(batch), batch.column("tree").to_numpy()
            outer = batch.column("shard").to_numpy().view(np.uint64)
            for number in np.unique(tree).tolist():
                rows = np.flatnonzero(tree == number)
                for part, sub in enumerate(forest.deep[number]):
                    for leaf, at in sub.route(prints[rows, number // forest.blocks]):
                        shard = _mix(outer[rows[at]] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part << 32 | leaf)).view(np.int64)
                        yield _sharded_batch(batch, prints, shard, np.full(len(at), number, np.int32), rows[at])

    return large.mapInArrow(tidied(run), _SHARDED)


def shards(spark: SparkSession, points: DataFrame, forest: Forest, most_rows: int) -> DataFrame:
    """(shard, tree, node, prints), no shard larger than two chunks of most_rows: points within reach meet in one."""
    first = routed(points, forest)
    large = scratch.table(spark, shard_sizes(points, forest).where(F.col("n") > most_rows), "large-shards")
    if large.isEmpty():
        return first
    marked = first.join(large, "shard", "left")
    small, big = marked.where("n is null").drop("n"), marked.where("n is not null")
    if any(forest.deep):
        big = scratch.table(spark, _deeper(big.drop("n"), forest), "deep-shards")
        sizes = scratch.table(spark, big.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most_rows), "clouds")
        marked = big.join(sizes, "shard", "left")
        small, big = small.unionByName(marked.where("n is null").drop("n")), marked.where("n is not null")
    chunks = F.ceil(F.col("n") / most_rows).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("chunk")), chunks).cast("int")
    dealt = big.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    return small.unionByName(dealt.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "tree", "node", "prints"))


class Ties:
    """Union-find over positions."""

    def __init__(self, size: int) -> None:
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def link_shard(prints: np.ndarray, block: np.ndarray, reach: int, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of all links in one shard; block: the bits of the shard's tree.

    A point that is near many others links them at once; these are not compared with one another.
    """
    n = len(prints)
    ties, label, found = Ties(n), np.arange(n), []

    def tie(a: np.ndarray, b: np.ndarray) -> None:
        """Link what is not yet in one component: one pair of every two components that meet."""
        new = label[a] != label[b]
        a, b = a[new], b[new]
        if not len(a):
            return
        x, y = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        first = np.unique(x * n + y, return_index=True)[1]
        found.extend((int(a[k]), int(b[k])) for k in first if ties.tie(int(x[k]), int(y[k])))
        met, change = np.unique(np.concatenate([x, y])), np.arange(n)
        change[met] = [ties.root(r) for r in met.tolist()]
        label[:] = change[label]

    core = np.zeros(n, bool)
    if n > 4 * _HUB:
        some = np.linspace(0, n - 1, 16).astype(int)
        near = np.stack([_distance(prints, prints[k]) <= radius for k in some])
        hub = int(near.sum(axis=1).argmax())
        if near[hub].sum() > _HUB:
            core = near[hub]
            others = np.flatnonzero(core)
            tie(np.full(len(others), some[hub]), others)
    step = max(1, min(256, _PAIRS // max(1, n)))
    for lo in range(0, n - 1, step):
        hi = min(n, lo + step)
        near = np.bitwise_count(block[lo:hi, None] ^ block[None, lo + 1 :]) <= reach
        near &= np.arange(lo + 1, n)[None, :] > np.arange(lo, hi)[:, None]
        if core.any():
            near &= ~(core[lo:hi, None] & core[None, lo + 1 :])
        a, b = np.nonzero(near)
        if len(a):
            a, b = a + lo, b + lo + 1
            good = _distance(prints[a], prints[b]) <= radius
            tie(a[good], b[good])
    return found


def links(sharded: DataFrame, forest: Forest, radius: int) -> DataFrame:
    """(shard, tree, node, prints) -> (a, b): links that join all nodes within radius of one another in a shard."""
    dealt = sharded.repartition("shard").sortWithinPartitions("shard")

    def solve(part: pa.RecordBatch) -> pa.RecordBatch:
        shard, node, prints = part.column("shard").to_numpy(), part.column("node").to_numpy(), _prints(part)
        number = part.column("tree").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist()
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo > 1:
                tree, own = forest.trees[number[lo]], prints[lo:hi]
                found = link_shard(own, own[:, number[lo] // forest.blocks] & np.uint64(tree.mask), tree.reach, radius)
                if found:
                    pairs = np.array(found) + lo
                    a.append(node[pairs[:, 0]]), b.append(node[pairs[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            shard = batch.column("shard").to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
            if held and (cut or shard[0] != held[-1].column("shard")[0].as_py()):
                yield solve(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield solve(batch.slice(0, cut))
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.concat_batches(held))

    return dealt.mapInArrow(tidied(run), "a long, b long")


def components(spark: SparkSession, points: DataFrame, radius: int = 4, blocks: int = 3, reach: int | None = None, leaf_rows: int = 1024, most_rows: int = 65_536, sample_rows: int = 32_768) -> DataFrame:
    """(node, prints), distinct and written -> (node, root) of the nodes that have a link; root is the least node.

    reach defaults to what brings all links together: radius // (blocks of all prints).
    """
    rows = points.count()
    sample = points.orderBy(F.xxhash64("prints"), "node").limit(sample_rows).select("prints").toPandas()["prints"].to_list()
    prints = len(sample[0]) if sample else 1
    reach = radius // (blocks * prints) if reach is None else reach
    forest = Forest.grow(np.array(sample, np.int64).reshape(-1, prints).view(np.uint64), rows, blocks, reach, radius, leaf_rows)
    edges = links(shards(spark, points, forest, most_rows), forest, radius)
    return connected_components(spark, edges).select("node", F.col("component").alias("root"))


def text_key(text: str) -> F.Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words_per_shingle: int = 4, **search: int) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (least doc_id reachable)."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    printed = scratch.table(spark, add_fingerprints(texts, "text", words_per_shingle).select("doc_id", "prints"), "fingerprints")
    points = scratch.table(spark, printed.groupBy("prints").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "points")
    joined = components(spark, points.select("node", "prints"), **search)
    rooted = scratch.table(spark, points.join(joined, "node", "left").select("prints", F.coalesce("root", "node").alias("root"), "least"), "rooted")
    named = with_least(rooted, "root", "least", rooted.count()).select("prints", F.col("m").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex(F.col("prints")[0]), 16, "0"))
    return printed.join(named, "prints").select("doc_id", hexed.alias("fingerprint"), "component_id")
