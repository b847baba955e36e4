"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

The pre-tokens of a batch that this worker has not met yet become rows of byte ids,
bucketed by length and padded. In each round every unfinished row merges its
leftmost pair of minimum rank; pair ranks come from an open-addressing hash table,
the row is closed up behind the merged pair, and finished rows leave the matrix.

A pre-token beyond the last width is cut into rows of that width, which are merged
like all others, and then stitched: ids that follow one another are those of the
whole exactly if every two neighbours are the encoding of their joint bytes. Where
the neighbours at a seam are not, a few ids on both sides are merged again, more of
them until they fit what is left and right of them. All seams of a level are rows of
one matrix, so one run of letters takes time in proportion to its length.

Documents are mapped partition by partition, without a shuffle. Edge cases: null
and empty texts give no ids; repeated rows are encoded alike; columns of the input
with the name of a result are replaced, others pass through. No documents, no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnwick.llm.batches import append_columns, caches
from tarnwick.llm.units import PieceCache, cutter

_WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64)
#: Cells of one matrix.
_CELLS = 1 << 22
#: Bytes of text that are split and merged at a time; bounds what a worker holds beside its cache.
_SLICE_BYTES = 1 << 20
_NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> merged id, by linear probing over two flat arrays."""

    def __init__(self, keys: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, _NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.merged[slot[placed]] = keys[placed], merged[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, _NONE where there is no such pair; negative ids are padding."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.merged[slot], _NONE)
        rest = np.flatnonzero((found != keys) & (found != -1) & (keys >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.merged[slot[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out


class ByteBpe:
    """One vocabulary of byte-level BPE ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.fitting: dict[tuple[int, int], bool] = {}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = PairTable(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.pieces = PieceCache(cutter(pattern), self.encode_tokens)

    def encode_tokens(self, tokens: list[bytes]) -> list[bytes]:
        """Packed little-endian ids of each pre-token."""
        out: list[bytes] = [b""] * len(tokens)
        short, long = [], []
        for n, t in enumerate(tokens):
            if t in self.ranks:
                out[n] = self.ranks[t].to_bytes(4, "little")
            else:
                (short if len(t) <= _WIDTHS[-1] else long).append(n)
        for rows, solve in ((short, self._matrices), (long, self._stitched)):
            for n, ids in zip(rows, solve([tokens[n] for n in rows]), strict=True):
                out[n] = ids.astype("<u4").tobytes()
        return out

    def _matrices(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of each row, merged with the others of its width."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(tokens)
        buckets: dict[int, list[int]] = {}
        for n, t in enumerate(tokens):
            width = next((w for w in _WIDTHS if len(t) <= w), 1 << (len(t) - 1).bit_length())
            buckets.setdefault(width, []).append(n)
        for width, rows in buckets.items():
            for lo in range(0, len(rows), max(1, _CELLS // width)):
                some = rows[lo : lo + max(1, _CELLS // width)]
                for n, ids in zip(some, self._merge([tokens[n] for n in some], width), strict=True):
                    out[n] = ids
        return out

    def _fit(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether two ids are the encoding of their joint bytes."""
        new = list(set(pairs).difference(self.fitting))
        if len(self.fitting) > _CELLS:
            self.fitting.clear()
            new = list(set(pairs))
        for (a, b), ids in zip(new, self._matrices([self.tokens[a] + self.tokens[b] for a, b in new]), strict=True):
            self.fitting[a, b] = ids.tolist() == [a, b]
        return [self.fitting[p] for p in pairs]

    def _stitched(self, tokens: list[bytes]) -> list[np.ndarray]:
        width = _WIDTHS[-1]
        cut = [[t[k : k + width] for k in range(0, len(t), width)] for t in tokens]
        flat = iter(self._matrices([row for rows in cut for row in rows]))
        parts = [[next(flat).tolist() for _ in rows] for rows in cut]
        while any(len(p) > 1 for p in parts):
            seams = [(p[k], p[k + 1]) for p in parts for k in range(0, len(p) - 1, 2)]
            joined = iter(self._seams(seams))
            parts = [[next(joined) if k + 1 < len(p) else p[k] for k in range(0, len(p), 2)] for p in parts]
        return [np.array(p[0] if p else [], np.int64) for p in parts]

    def _seams(self, seams: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """Each left part followed by its right part."""
        out: list[list[int]] = [[]] * len(seams)
        open_, reach = [], 1
        for n, fits in enumerate(self._fit([(a[-1], b[0]) for a, b in seams])):
            if fits:
                out[n] = seams[n][0] + seams[n][1]
            else:
                open_.append(n)
        while open_:
            words = [b"".join(self.tokens[i] for i in seams[n][0][-reach:] + seams[n][1][:reach]) for n in open_]
            middle = [m.tolist() for m in self._matrices(words)]
            edges = [(n, m, seams[n][0][:-reach], seams[n][1][reach:]) for n, m in zip(open_, middle, strict=True)]
            left = self._fit([(a[-1], m[0]) if a else (m[0], m[0]) for _, m, a, _ in edges])
            right = self._fit([(m[-1], b[0]) if b else (m[0], m[0]) for _, m, _, b in edges])
            open_ = []
            for (n, m, a, b), x, y in zip(edges, left, right, strict=True):
                if (x or not a) and (y or not b):
                    out[n] = a + m + b
                else:
                    open_.append(n)
            reach *= 2
        return out

    def _merge(self, tokens: list[bytes], width: int) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in tokens])
        raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(-1, width)
        ids = self.byte_id[raw]
        ids[np.arange(width) >= sizes[:, None]] = -1
        done: list[np.ndarray | None] = [None] * len(tokens)
        row = np.arange(len(tokens))
        rank = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row):
            at = rank.argmin(axis=1)
            lines = np.arange(len(row))
            best = rank[lines, at]
            for k in np.flatnonzero(best == _NONE):
                done[row[k]] = ids[k]
            busy = best != _NONE
            row, ids, rank, at, best = row[busy], ids[busy], rank[busy], at[busy], best[busy]
            if not len(row):
                break
            lines = np.arange(len(row))
            ids[lines, at] = best
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            if ids.shape[1] < 2:
                for k in lines:
                    done[row[k]] = ids[k]
                break
            column = column[:-1]
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), 1)
            for side in (at - 1, at):
                inside = (side >= 0) & (side < rank.shape[1])
                where, side = lines[inside], side[inside]
                rank[where, side] = self.pairs(ids[where, side], ids[where, side + 1])
        return [x[x >= 0] for x in done]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBpe] = {}
caches.append(_loaded.clear)


def load(path: str, pattern: str) -> ByteBpe:
    """The worker's own copy of a vocabulary, read once from its place on the node."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs plus token_ids (packed little-endian unsigned 32-bit) and n_tokens."""

    def work(batch: list[bytes]) -> list[pa.Array]:
        ids = load(path, pattern).pieces.texts(batch)
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return append_columns(docs, text, [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], work, _SLICE_BYTES)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded plus decoded: the bytes that token_ids stand for."""

    def work(batch: list[bytes]) -> list[pa.Array]:
        bpe = load(path, pattern)
        return [pa.array([bpe.decode(x) for x in batch], pa.binary())]

    return append_columns(encoded, "token_ids", [T.StructField("decoded", T.BinaryType())], work)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """docs plus n_tokens and SHA-256 of the packed ids and of the decoded bytes, on demand token_ids.

    Encoding and decoding meet in one Python step, so ids cross to the JVM only if kept.
    """

    def work(batch: list[bytes]) -> list[pa.Array]:
        bpe = load(path, pattern)
        ids = bpe.pieces.texts(batch)
        hashes = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, hashes)] + [pa.array(ids, pa.binary())] * keep_ids

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return append_columns(docs, text, fields + [T.StructField("token_ids", T.BinaryType())] * keep_ids, work, _SLICE_BYTES)
