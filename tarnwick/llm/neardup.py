"""Near-duplicate groups: SimHash candidates, verified by exact word shingles.

Candidates are the components of the vantage-point forest (see simhash) over four
fingerprints of a text's five-word shingles, 16 trees of 16 bits each, that differ
in at most 56 of 256 bits. Two texts whose shingles have a Jaccard similarity of 0.8
differ in 15 % of the bits; they are within one bit in some block with probability
0.99 and within 56 bits in all with probability 0.998. The tests measure the recall.

Candidates are then compared by their exact shingles and groups are built from the
links that hold, so no chance collision drops a text. In each of ``rounds`` rounds one
text of a component that is not yet one group is compared with all others and
leaves; components that then still hold several groups are dealt into chunks, and
every pair of chunks is a shard in which all pairs across groups are compared. A shard returns
a spanning forest of its links, never all pairs.

Only distinct texts are compared. Edge cases: a text of fewer than five words has
one shingle, the text; null, empty and blank texts have none and are alike. Case of
A-Z and the kind of white space do not count. Rows with a null doc_id are kept only
if no row of their group has one; of rows that share id and text one is kept, the
first by all its columns. Extra columns pass through. No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import scratch
from tarnwick.llm.batches import LOWER, leave, tidied
from tarnwick.llm.batches import texts as texts_of
from tarnwick.llm.simhash import Ties, add_fingerprints, components, text_key
from tarnwick.operators.components import connected_components

WORDS, SIMILARITY = 5, 0.8
#: How candidates are searched: fingerprints a text, blocks (trees) a fingerprint, bits within a block, bits in all.
SEARCH = {"blocks": 4, "reach": 1, "radius": 56}
PRINTS = 4


def shingles(text: bytes) -> set[bytes]:
    words = text.translate(LOWER).split()
    if not words:
        return set()
    k, line = min(WORDS, len(words)), b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return {line[a : b - 1] for a, b in zip([0, *ends], ends[k - 1 :], strict=False)}


def similarity(a: set[bytes], b: set[bytes]) -> float:
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def verified(spark: SparkSession, pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Those (a, b) whose texts are similar; bodies (node, text) has one row a node."""
    both = pairs.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(shingles((x.as_py() or "").encode()), shingles((y.as_py() or "").encode())) >= SIMILARITY for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return scratch.table(spark, both.select("a", "b", "text_a", "text_b").mapInArrow(tidied(run), "a long, b long"), "links")


def link_across(nodes: list[int], roots: list[int], chunks: list[int], texts: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest of the links between groups in one shard; across chunks only if the shard has two.

    Sizes of intersections come from hashed shingles, all texts at once; a link that
    these show is confirmed by the shingles themselves.
    """
    hashes = [np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles(t)), np.uint64)) for t in texts]
    hashes = [h if len(h) else np.zeros(1, np.uint64) for h in hashes]
    size = np.array([len(h) for h in hashes])
    ids = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    begin = np.concatenate([[0], size.cumsum()])
    mark = np.zeros(int(ids.max()) + 1, np.int32)
    names, root = np.unique(roots, return_inverse=True)
    chunk, ties, found = np.array(chunks), Ties(len(names)), []
    two = chunk.min() != chunk.max()
    for i in range(len(nodes) - 1):
        rest = slice(i + 1, None)
        todo = (root[rest] != root[i]) & (np.minimum(size[rest], size[i]) >= SIMILARITY * np.maximum(size[rest], size[i]) - 1e-6)
        if two:
            todo &= chunk[rest] != chunk[i]
        if not todo.any():
            continue
        mark[ids[begin[i] : begin[i + 1]]] = 1
        both = np.add.reduceat(mark[ids[begin[i + 1] :]], begin[i + 1 : -1] - begin[i + 1])
        mark[ids[begin[i] : begin[i + 1]]] = 0
        for j in (np.flatnonzero(todo & (both >= SIMILARITY * (size[rest] + size[i] - both) - 1e-6)) + i + 1).tolist():
            if ties.root(root[i]) != ties.root(root[j]) and similarity(shingles(texts[i]), shingles(texts[j])) >= SIMILARITY:
                ties.tie(root[i], root[j])
                found.append((nodes[i], nodes[j]))
    return found


def across(spark: SparkSession, members: DataFrame, bodies: DataFrame) -> DataFrame:
    """(root, node, own_root, chunks) -> (a, b): links that join what is alike in a component but not yet in one group."""
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = members.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sharded = dealt.select("root", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "node", "own_root", "chunk")

    def solve(shard: pa.Table) -> pa.Table:
        column = {n: shard.column(n).to_pylist() for n in ("node", "own_root", "chunk")}
        found = link_across(column["node"], column["own_root"], column["chunk"], texts_of(shard.column("text")))
        leave()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return scratch.table(spark, sharded.join(bodies.select("node", "text"), "node").groupBy("root", "lo", "hi").applyInArrow(solve, "a long, b long"), "links")


def candidates(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, text, text_key) -> points (node, text_key, least, prints), one a text, and (node, root) of its SimHash component."""
    printed = add_fingerprints(rows, "text", WORDS, PRINTS).select("doc_id", "text_key", "prints")
    points = scratch.table(spark, printed.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.first("prints").alias("prints")).withColumn("node", F.monotonically_increasing_id()), "points")
    # Texts with equal fingerprints are one point of the forest.
    distinct = scratch.table(spark, points.groupBy("prints").agg(F.min("node").alias("node")), "distinct-prints")
    joined = components(spark, distinct.select("node", "prints"), **SEARCH)
    rooted = distinct.join(joined, "node", "left").select("prints", F.coalesce("root", "node").alias("root"))
    return points, scratch.table(spark, points.select("node", "prints").join(rooted, "prints").select("node", "root"), "candidates")


def near_groups(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = 2, chunk_rows: int = 256, chunk_bytes: int = 8 << 20) -> DataFrame:
    """One row per distinct text: text_key, node, root (least node of its group), least (its least doc_id, null if none)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("text_key"))
    points, rooted = candidates(spark, rows)
    many = rooted.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    members = scratch.table(spark, rooted.join(many, "root"), "members")
    known = members.select("node").join(points.select("node", "text_key"), "node")
    bodies = scratch.table(spark, rows.select("text_key", "text").join(known, "text_key").groupBy("node").agg(F.first("text").alias("text")).withColumn("bytes", F.octet_length("text")), "bodies")

    links = spark.createDataFrame([], "a long, b long")
    left = members.withColumn("own_root", F.col("node"))
    for _ in range(rounds):
        # One text of the last group of each component that is still apart meets all others.
        lead = F.max(F.struct("own_root", "node"))
        leaders = scratch.table(spark, left.groupBy("root").agg(F.min("own_root").alias("lo"), lead.alias("lead")).where("lo <> lead.own_root").select("root", F.col("lead.own_root").alias("group"), F.col("lead.node").alias("a")), "leaders")
        if leaders.isEmpty():
            break
        met = left.join(leaders, "root")
        links = links.unionAll(verified(spark, met.where("own_root <> group").select("a", F.col("node").alias("b")), bodies))
        joined = connected_components(spark, links)
        left = scratch.table(spark, met.where("node <> a").select("root", "node").join(joined, "node", "left").select("root", "node", F.coalesce("component", "node").alias("own_root")), "left")
    size = F.greatest(F.count("*") / chunk_rows, F.sum("bytes") / chunk_bytes)
    mixed = left.join(bodies.select("node", "bytes"), "node").groupBy("root").agg(F.min("own_root").alias("lo"), F.max("own_root").alias("hi"), F.ceil(size).cast("int").alias("chunks")).where("lo <> hi").select("root", "chunks")
    mixed = scratch.table(spark, mixed, "mixed")
    if not mixed.isEmpty():
        links = links.unionAll(across(spark, left.join(mixed, "root"), bodies))

    named = connected_components(spark, links).select("node", F.col("component").alias("root"))
    return scratch.table(spark, points.select("text_key", "node", "least").join(named, "node", "left").withColumn("root", F.coalesce("root", "node")), "groups")


def keep_one(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how: int) -> DataFrame:
    """docs with one row of each group: the one of least doc_id (null last), then text key."""
    first = near_groups(spark, docs, text, doc_id, **how).groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("unknown"), "least", "text_key")).alias("kept"))
    chosen = first.select(F.coalesce(F.col("kept.least").cast("string"), F.lit("")).alias("__id"), F.col("kept.text_key").alias("__key"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "__key": text_key(text)})
    # Rows that share id and text differ only in other columns: the least of these stays, whatever the partitioning.
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]))
    row = keyed.join(chosen, ["__id", "__key"], "left_semi").withColumn("__rest", rest)
    return row.groupBy("__id", "__key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "__rest").alias("__row")).select("__row.*")
