"""Arrow-batch plumbing shared by the operators that read whole texts in Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of Python work holds at a time.
SLICE_BYTES = 4 << 20
#: a-z for A-Z, every other byte unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: What empties the caches of the operators that this worker has loaded, and the one whose caches are filled.
caches: list[Callable[[], None]] = []
_owner = ""
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def enter(owner: str) -> None:
    """Workers outlive stages: the caches of another operator are emptied."""
    global _owner
    if owner != _owner:
        for forget in caches:
            forget()
        _owner = owner


def leave() -> None:
    """Give the memory that a task has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidied(run: Run, owner: str = "") -> Run:
    """run, holding no other operator's caches while it works and no freed memory afterwards."""
    owner = owner or run.__module__

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        try:
            yield from run(batches)
        finally:
            leave()

    return held


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the running size of a column passes limit."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], work: Callable[[list[bytes]], list[pa.Array]], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """df plus fields computed from whole texts, partition by partition, no shuffle.

    work maps a list of UTF-8 texts to one Arrow array per field. Columns of df
    that clash with a new field are replaced; all others pass through.
    """
    new = {f.name for f in fields}
    left = [f for f in df.schema.fields if f.name not in new]
    read = [f.name for f in left] + [text] * (text in new)  # a text that a result replaces is read all the same
    held = df.select(*[F.col(f"`{c}`") for c in read]).toDF(*[f"c{n}" for n in range(len(read))])
    at, names = read.index(text), [f.name for f in left + fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{at}", slice_bytes):
                yield pa.RecordBatch.from_arrays(part.columns[: len(left)] + work(texts(part.column(at))), names=names)

    return held.mapInArrow(tidied(run, work.__module__), T.StructType(left + fields))
