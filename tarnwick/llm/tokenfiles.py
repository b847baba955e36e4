"""Token-id output: Arrow stream-file format with fixed-size-list batches.

Documents are dealt by ranges of doc_id and sorted, each partition encodes its
texts and writes Arrow IPC files. A row of a file is one sequence of ``length``
ids with two masks of the same length: ``valid`` (false in the padding that ends a
file) and ``starts`` (true where a document begins), and the ids of the documents
that begin in it. Every list has one fixed size and a file is one batch, so a
memory-mapped file gives any sequence without a copy. Ids are stored in 16 bits
where the vocabulary allows.

Files are cut at ``file_tokens``, whatever a partition holds. They are placed behind
one another by running sums over the manifest, in blocks of partitions, so that no
task meets every file; contents of files are never shuffled.

Edge cases: null and empty texts consist of the end id alone; null doc_ids come
first, equal ones by text hash; repeated rows are each written. Only doc_id and text
are read, whatever else the table holds. No documents give no files, and reading
them back gives no rows.
"""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick import scratch
from tarnwick.llm.batches import caches, slices, texts, tidied
from tarnwick.llm.files import put
from tarnwick.llm.units import BYTE_LEVEL, PieceCache, cutter, plain, plain_edges

#: Bytes of text that are cut at a time.
_SLICE_BYTES = 2 << 20
#: Partitions whose files are placed by one task.
_BLOCK = 1024


def _alphabet() -> str:
    """The character that byte-level vocabularies have for each byte: its own if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


class LibraryEncoder:
    """Encodes texts as the tokenizers library does with add_special_tokens=False.

    Texts are cut many at a time, Arrow tells their pre-tokens apart, and the library's
    model encodes every distinct one once. A text that holds an added token of the
    tokenizer, or a character beyond ASCII that is no letter, goes through the library
    as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
            raise ValueError("a byte-level tokenizer without normalizer is needed")
        self.model, self.alphabet = self.tokenizer.model, _alphabet()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = PieceCache(cutter(BYTE_LEVEL), self.encode_pieces)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        if not pieces:
            return []
        tokenize = self.model.tokenize
        # the byte 255 is in no UTF-8, and its character is its own
        found = [[t.id for t in tokenize(p)] for p in codecs.charmap_decode(b"\xff".join(pieces), "strict", self.alphabet)[0].split("\xff")]
        data = np.array([i for ids in found for i in ids], "<u4").tobytes()
        edge = np.cumsum([0, *(4 * len(ids) for ids in found)]).tolist()
        return [data[a:b] for a, b in zip(edge, edge[1:])]  # noqa: B905

    def plain_texts(self, batch: list[bytes]) -> list[bytes]:
        """Packed ids of each of these plain texts."""
        begins = np.cumsum([0, *map(len, batch)])
        data = b"".join(batch)
        edges = plain_edges(data, begins)
        pieces = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        packed, place = self.pieces.each(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pieces.indices.to_numpy()
        ids, width = np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start, sizes = (np.cumsum(width) - width)[place], width[place]
        behind = np.concatenate([[0], np.cumsum(sizes)])
        out = ids[np.repeat(start - behind[:-1], sizes) + np.arange(behind[-1])].tobytes()
        cut = (4 * behind[np.searchsorted(edges, begins)]).tolist()
        return [out[a:b] for a, b in zip(cut, cut[1:])]  # noqa: B905

    def texts(self, batch: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        whole = [n for n, t in enumerate(batch) if any(a in t for a in self.added) or not plain(t)]
        skip = set(whole)
        out = self.plain_texts([b"" if n in skip else t for n, t in enumerate(batch)])
        for n in whole:
            out[n] = np.array(self.tokenizer.encode(batch[n].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


_loaded: dict[str, LibraryEncoder] = {}
caches.append(_loaded.clear)


def load(path: str) -> LibraryEncoder:
    if path not in _loaded:
        _loaded[path] = LibraryEncoder(path)
    return _loaded[path]


class _Writer:
    """Packs documents into sequences and writes a file whenever one is full."""

    def __init__(self, folder: str, part: int, length: int, file_tokens: int, kind: type) -> None:
        self.folder, self.part, self.length, self.kind = folder, part, length, kind
        self.room, self.number = max(1, file_tokens), 0
        self._clear()

    def _clear(self) -> None:
        self.ids: list[bytes] = []
        self.sizes: list[int] = []
        self.docs: list[int | None] = []
        self.total = 0

    def add(self, doc: int | None, packed: bytes) -> Iterator[dict]:
        self.ids.append(np.frombuffer(packed, "<u4").astype(self.kind).tobytes())
        self.sizes.append(len(packed) // 4)
        self.docs.append(doc)
        self.total += len(packed) // 4
        if self.total >= self.room:
            yield from self.flush()

    def flush(self) -> Iterator[dict]:
        if not self.docs:
            return
        rows = -(-self.total // self.length)
        ids = np.zeros(rows * self.length, self.kind)
        ids[: self.total] = np.frombuffer(b"".join(self.ids), self.kind)
        valid, starts = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        valid[: self.total] = True
        begin = np.cumsum([0, *self.sizes[:-1]])
        starts[begin] = True
        per_row = np.bincount(begin // self.length, minlength=rows)
        offsets = pa.array(np.concatenate([[0], per_row.cumsum()]), pa.int32())
        batch = pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, valid, starts)] + [pa.ListArray.from_arrays(offsets, pa.array(self.docs, pa.int64()))],
            names=["input_ids", "valid", "starts", "doc_ids"],
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, batch.schema) as out:
            out.write_batch(batch)
        name = f"part-{self.part:08d}-{self.number:06d}.arrow"
        put(f"{self.folder}/{name}", sink.getvalue())
        counts = {"part": self.part, "file": name, "n_docs": len(self.docs), "n_tokens": self.total}
        self.number += 1
        self._clear()
        yield counts


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str, path: str, end_id: int = 2, length: int = 2048, vocabulary: int = 50_257, file_tokens: int = 4 << 20, partition_bytes: int = 24 << 20) -> DataFrame:
    """Write docs (doc_id, text) below folder; returns the manifest (part, file, n_docs, n_tokens)."""
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    scratch.make_folder(spark, folder)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    salt = F.xxhash64("text")
    dealt = docs.select("doc_id", "text").repartitionByRange(max(1, -(-size // partition_bytes)), "doc_id", salt).sortWithinPartitions("doc_id", salt, "text")
    end = int(end_id).to_bytes(4, "little")
    manifest = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, TaskContext.get().partitionId(), length, file_tokens, kind)
        encoder = load(path)
        counts: list[dict] = []
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.texts(texts(part.column("text"))), strict=True):
                    counts += writer.add(doc, ids + end)
        counts += writer.flush()
        if counts:
            yield pa.RecordBatch.from_pylist(counts, manifest)

    return scratch.table(spark, dealt.mapInArrow(tidied(run), "part long, file string, n_docs long, n_tokens long"), "manifest")


def sequences(data: pa.Buffer | bytes | pa.NativeFile) -> pa.RecordBatch:
    """All sequences of one file, on the file's own memory (for instance of pa.memory_map)."""
    source = data if isinstance(data, pa.NativeFile) else pa.py_buffer(data)
    return pa.ipc.open_file(source).get_batch(0)


def documents_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, first token in the file, ids) of each document of a file; ids are views."""
    ids = batch.column("input_ids").flatten().to_numpy()
    valid, starts = (batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("valid", "starts"))
    begin, total = np.flatnonzero(starts).tolist(), int(valid.sum())
    docs = batch.column("doc_ids").flatten().to_pylist()
    for doc, a, b in zip(docs, begin, [*begin[1:], total], strict=True):
        yield doc, a, ids[a:b]


def placed(manifest: DataFrame) -> DataFrame:
    """(file, base): tokens of all files before each file."""
    block = manifest.select("file", "n_tokens", F.floor(F.col("part") / _BLOCK).alias("block"))
    inside = Window.partitionBy("block").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sums = block.groupBy("block").agg(F.sum("n_tokens").alias("n")).select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("base"))
    return block.join(sums, "block").select("file", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0).cast("long"))).alias("base"))


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.arrow").load(folder)
    files = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    numbers = ("doc_id", "place", "n_tokens", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("file"), batch.column("content"), strict=True):
                rows = [(d, a, len(ids), zlib.crc32(ids.astype("<u4"))) for d, a, ids in documents_of(sequences(data.as_buffer()))]
                columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows)), *columns], names=["file", *numbers])

    schema = T.StructType([T.StructField("file", T.StringType()), *(T.StructField(n, T.LongType()) for n in numbers)])
    return files.mapInArrow(tidied(run), schema).join(placed(manifest), "file").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
