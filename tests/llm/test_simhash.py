"""Fingerprints and components against definitions computed bit by bit."""

import random

import numpy as np
import pytest
import xxhash

from tarnwick.llm import simhash


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    k = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(points, radius=4):
    parent = list(range(len(points)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(points)):
        for b in range(a):
            if (points[a] ^ points[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(n) for n in range(len(points))]


def test_odd_documents(spark, odd_documents):
    found = simhash.near_duplicates(spark, odd_documents).collect()
    rows = odd_documents.select("doc_id", "text").collect()
    prints = {r["text"]: slow_print(r["text"]) for r in rows}
    key = lambda *x: str(x)
    assert sorted(key(r["doc_id"], r["fingerprint"]) for r in found) == sorted(key(r["doc_id"], f"{prints[r['text']]:016x}") for r in rows)
    label, least = components([prints[r["text"]] for r in rows]), {}
    for r, c in zip(rows, label, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    assert sorted(key(r["doc_id"], r["component_id"]) for r in found) == sorted(key(r["doc_id"], least.get(c)) for r, c in zip(rows, label, strict=True))


def test_none(spark, no_documents):
    assert simhash.near_duplicates(spark, no_documents).count() == 0


def clouds(seed):
    rng = random.Random(seed)
    centre = [rng.getrandbits(64) for _ in range(3)]
    points = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(90)} | {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1}
    return sorted(points)


def grouped(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(n)]


@pytest.mark.parametrize(("leaf_rows", "most_rows", "sample_rows"), [(8, 8, 400), (8, 40, 50), (40, 90, 400), (1024, 10_000, 400), (16, 10_000, 1)])
def test_forest_finds_every_link(spark, leaf_rows, most_rows, sample_rows):
    points = clouds(leaf_rows + most_rows)
    frame = spark.createDataFrame([(n, [p - (1 << 64) if p >> 63 else p]) for n, p in enumerate(points)], "node long, prints array<long>")
    sample = np.array(points[:: max(1, len(points) // sample_rows)], np.uint64).reshape(-1, 1)
    forest = simhash.Forest.grow(sample, len(points), 3, 1, 4, leaf_rows)
    sharded = simhash.shards(spark, frame, forest, most_rows)
    if most_rows < 50:
        assert sharded.groupBy("shard").count().agg({"count": "max"}).first()[0] < len(points) / 2
    edges = [(r["a"], r["b"]) for r in simhash.links(sharded, forest, 4).collect()]
    assert all((points[a] ^ points[b]).bit_count() <= 4 for a, b in edges)
    assert grouped(len(points), edges) == components(points)
    found = {r["node"]: r["root"] for r in simhash.components(spark, frame, leaf_rows=leaf_rows, most_rows=most_rows, sample_rows=sample_rows).collect()}
    assert [found.get(n, n) for n in range(len(points))] == components(points)


def test_trees_prune_and_lose_no_neighbour():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 1 << 63, 20_000, np.uint64)
    (mask, *_) = simhash.masks(3)
    tree = simhash.Tree.grow(points[:4000], mask, 1, 20)
    held = [set() for _ in points]
    for leaf, at in tree.route(points):
        for k in at.tolist():
            held[k].add(leaf)
    leaves = sum(x < 0 for x in tree.inner)
    assert leaves > 100 and sum(map(len, held)) < 8 * len(points) and max(map(len, held)) < leaves / 4  # whole branches are out of reach
    for k in range(0, 300):
        away = np.bitwise_count((points ^ points[k]) & np.uint64(mask))
        assert all(held[k] & held[j] for j in np.flatnonzero(away <= 1).tolist())


def test_large_shard_equals_brute_force():
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    points = np.array(sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8))) for _ in range(400)}), np.uint64)
    found = simhash.link_shard(points.reshape(-1, 1), points, 4, 4)
    assert len(found) < len(points) and grouped(len(points), found) == components([int(p) for p in points])


def test_query_equals_brute_force(spark):
    from helpers import SMALL

    from tarnwick.llm import queries
    from tarnwick.tables import read_table

    rows = sorted((r["doc_id"], r["text"]) for r in read_table(spark, SMALL, "documents").collect())
    prints = [slow_print(t) for _, t in rows]
    wanted = [(d, f"{p:016x}", rows[c][0]) for (d, _), p, c in zip(rows, prints, components(prints), strict=True)]
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, SMALL).collect()) == wanted
