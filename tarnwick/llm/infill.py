"""Fill-in-middle: texts cut at two units and put together with their middle last.

A unit is a word with the white space before it; white space at the end of a text is a
unit too. A text is seen as fixed blocks of bytes. Each block's number of units (that
end in it) and of code points (that begin in it) go into a Fenwick tree; a cut after
``u`` units is found by descending the tree in halves to the block in which unit ``u``
ends, and then inside that block alone. The tree gives the code points before the
block on the way, so prefix and middle are measured without reading the text again.

Cuts and forms are drawn from a digest of the seed and the document's id alone, so a
task that runs again writes the same output.

Edge cases: null and empty texts are plain, with no units and the empty output; texts
that hold a marker are plain. A null id draws as the empty one. Repeated rows are cut
alike. Columns of the input with the name of a result are replaced, others pass
through. A text of any length is one row. No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.batches import slices, texts, tidied

#: Before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FIELDS = [("n_units", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("fim_text", T.StringType())]


class BlockTree:
    """Fenwick tree over the blocks of one text: units that end in a block, code points that begin in it."""

    def __init__(self, text: bytes, block: int) -> None:
        self.raw, self.block = np.frombuffer(text, np.uint8), block
        edges = np.arange(0, len(text), block)
        tree = np.zeros((len(edges) + 1, 2), np.int64)
        if len(edges):
            tree[1:, 0] = np.add.reduceat(self._ends(0, len(text)), edges, dtype=np.int64)
            tree[1:, 1] = np.add.reduceat((self.raw & 0xC0) != 0x80, edges, dtype=np.int64)
        self.units = int(tree[:, 0].sum())
        step = 1
        while 2 * step < len(tree):  # a node adds the node of half its span to its own
            into = np.arange(2 * step, len(tree), 2 * step)
            tree[into] += tree[into - step]
            step *= 2
        self.tree, self.top = tree.tolist(), step

    def _ends(self, begin: int, end: int) -> np.ndarray:
        """Mask of the bytes begin..end with which a unit ends: no white space follows none, or the text is over."""
        space = _SPACE[self.raw[begin : end + 1]]
        ends = ~space
        ends[:-1] &= space[1:]
        if end >= len(self.raw):
            ends[-1] = True
        return ends[: end - begin]

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first units of the text."""
        if units == 0:
            return 0, 0
        at, left, points, step = 0, units, 0, self.top
        while step:
            if at + step < len(self.tree) and self.tree[at + step][0] < left:
                at += step
                left -= self.tree[at][0]
                points += self.tree[at][1]
            step //= 2
        begin = at * self.block
        end = min(begin + self.block, len(self.raw))
        byte = begin + int(np.flatnonzero(self._ends(begin, end))[left - 1]) + 1
        return byte, points + int(((self.raw[begin:byte] & 0xC0) != 0x80).sum())


def _infilled(text: bytes, digest: bytes, fim_percent: int, spm_percent: int, markers: tuple[bytes, ...], block: int) -> tuple[int, str, int | None, int | None, bytes]:
    tree = BlockTree(text, block)
    h1, h2, h3, h4 = (int(digest[n : n + 8], 16) for n in (0, 8, 16, 24))
    if not text or h3 % 100 >= fim_percent or any(m in text for m in markers):
        return tree.units, "plain", None, None, text
    first, second = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    (a, a_points), (b, b_points) = tree.cut(first), tree.cut(second)
    begin, end, mid = markers
    if h4 % 100 < spm_percent:
        form, out = "spm", (end, text[b:], begin, text[:a], mid, text[a:b])
    else:
        form, out = "psm", (begin, text[:a], end, text[b:], mid, text[a:b])
    return tree.units, form, a_points, b_points - a_points, b"".join(out)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, markers: tuple[str, str, str] = MARKERS, block_bytes: int = 1024) -> DataFrame:
    """docs plus n_units, form (plain, psm or spm), prefix_chars, middle_chars and fim_text.

    psm is prefix, suffix, middle; spm suffix, prefix, middle, each after its marker.
    prefix_chars and middle_chars are null where the form is plain.
    """
    if len(set(markers)) != 3 or any(len(m) < 3 or m[0] in m[1:] or m[-1] in m[:-1] for m in markers):
        raise ValueError("markers must differ and have a first and a last character that is nowhere else in them")
    fields = [T.StructField(n, t) for n, t in _FIELDS]
    left = [f for f in docs.schema.fields if f.name not in {n for n, _ in _FIELDS}]
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    held = docs.select(*[F.col(f"`{f.name}`") for f in left], drawn, F.coalesce(F.col(f"`{text}`"), F.lit(""))).toDF(*[f"c{n}" for n in range(len(left))], "drawn", "read")
    marks = tuple(m.encode() for m in markers)
    names = [f.name for f in left + fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "read"):
                made = [_infilled(t, d, fim_percent, spm_percent, marks, block_bytes) for t, d in zip(texts(part.column("read")), texts(part.column("drawn")), strict=True)]
                units, form, prefix, middle, out = zip(*made, strict=True)
                columns = [pa.array(units, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(part.columns[: len(left)] + columns, names=names)

    return held.mapInArrow(tidied(run), T.StructType(left + fields))


def restored(fim_text: str = "fim_text", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that a row of fill_in_middle was made of, from its output and form alone."""
    begin, end, mid = markers
    out, psm = F.col(f"`{fim_text}`"), F.col(f"`{form}`") == "psm"
    head, middle = F.substring_index(out, mid, 1), F.substring_index(out, mid, -1)
    prefix = F.when(psm, F.substring_index(F.substring_index(head, end, 1), begin, -1)).otherwise(F.substring_index(head, begin, -1))
    suffix = F.when(psm, F.substring_index(head, end, -1)).otherwise(F.substring_index(F.substring_index(head, begin, 1), end, -1))
    return F.when(F.col(f"`{form}`") == "plain", out).otherwise(F.concat(prefix, middle, suffix))
