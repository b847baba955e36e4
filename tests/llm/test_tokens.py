"""BPE and token files against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from tarnwick import scratch
from tarnwick.llm import bpe, tokenfiles

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "'s", "'ll", "a", "Z", "é", "ß", "9", "½", ".", ",", "!!", "…", "日本", "😀", "́", "<|endoftext|>", "word", "\r\n", "_", "a" * 90, " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "\n\n", "a" * 3000, "ab" * 900, "ab " * 500, "!" * 1000]


def test_cutting_equals_the_pattern():
    import regex

    from tarnwick.llm.units import BYTE_LEVEL, cutter, plain

    assert BYTE_LEVEL == P.PATTERN
    texts = odd_texts()
    assert any(map(plain, (t.encode() for t in texts))) and not all(map(plain, (t.encode() for t in texts)))
    for text in texts:
        assert [p.decode() for p in cutter(P.PATTERN)(text.encode())] == regex.findall(P.PATTERN, text)


def test_cutting_many_texts_equals_the_pattern():
    import regex

    from tarnwick.llm.units import plain, plain_edges

    rng = random.Random(9)
    parts = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\r\n", "'", "''", "'s", "l", "ll", "re", "v", "e", "t", "d", "m", "a", "Z", "é", "日", "9", ".", "!", "_"]
    batches = [["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 8))] for _ in range(2000)]
    for batch in [*batches, [t for t in odd_texts() if plain(t.encode())]]:
        texts = [t.encode() for t in batch]
        edges = plain_edges(b"".join(texts), np.cumsum([0, *map(len, texts)])).tolist()
        found = [b"".join(texts)[a:b].decode() for a, b in zip(edges, edges[1:])]  # noqa: B905
        assert found == [p for t in batch for p in regex.findall(P.PATTERN, t)]


def test_known_pieces_take_less_time_than_text_by_text():
    """The encoder of token files beside one that cuts and looks up text by text, both knowing all pieces."""
    import time

    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("etaoinshré") for _ in range(rng.randint(1, 8))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(vocabulary, k=500)).encode() for _ in range(600)]
    encoder, took = tokenfiles.LibraryEncoder(JSON), []
    wanted = encoder.pieces.texts(texts)
    for work in (encoder.pieces.texts, encoder.texts):
        runs = []
        for _ in range(4):
            began = time.process_time()
            assert work(texts) == wanted
            runs.append(time.process_time() - began)
        took.append(min(runs))
    assert took[1] < 0.75 * took[0], took


def test_bpe_equals_tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteBpe(RANKS, P.PATTERN)
    texts = odd_texts()
    found = own.pieces.texts([t.encode() for t in texts])
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_long_pieces_take_time_in_proportion():
    """Letters without blanks, far beyond the last padded width."""
    import time

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, rng, took = bpe.ByteBpe(RANKS, P.PATTERN), random.Random(4), []
    for size in (12_000, 48_000):
        text = "".join(rng.choice("etaoinshr") for _ in range(size))
        began = time.process_time()
        (ids,) = own.pieces.texts([text.encode()])
        took.append(time.process_time() - began)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert took[1] < 8 * took[0] + 0.5


@pytest.mark.parametrize("widths", [(4, 8), (4, 8, 1 << 16)])
def test_widths_do_not_matter(monkeypatch, widths):
    texts = [t.encode() for t in odd_texts()[-7:]] + [b"unhappiness" * 9]
    wanted = bpe.ByteBpe(RANKS, P.PATTERN).pieces.texts(texts)
    monkeypatch.setattr(bpe, "_WIDTHS", widths)
    assert bpe.ByteBpe(RANKS, P.PATTERN).pieces.texts(texts) == wanted


def test_file_encoder_equals_tokenizers():
    library = Tokenizer.from_file(JSON)
    texts = [*odd_texts(), "a <|endoftext|> b", "plain words, 12 of them.\n\nend  "]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = tokenfiles.LibraryEncoder(JSON)
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.texts([t.encode() for t in texts])] == wanted


def test_round_trip_of_odd_documents(spark, odd_documents):
    found = bpe.decode(bpe.encode(odd_documents, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") and len(r["token_ids"]) == 4 * r["n_tokens"] for r in found)
    digests = {(r["doc_id"], r["decoded_sha256"]) for r in bpe.round_trip(odd_documents, RANKS, P.PATTERN).collect()}
    assert digests == {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in found}


@pytest.mark.parametrize("file_tokens", [50, 1 << 20])
def test_token_files(spark, odd_documents, file_tokens):
    folder = scratch.new_path(spark, "tokens")
    manifest = tokenfiles.write_tokens(spark, odd_documents, folder, JSON, length=64, file_tokens=file_tokens, partition_bytes=20_000)
    found = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read_documents(spark, folder, manifest).collect())
    library = Tokenizer.from_file(JSON)
    wanted = {}
    for r in odd_documents.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        wanted.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    order = [d for _, d, _, _ in found]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    start = 0
    for begin, doc, n, crc in found:
        assert begin == start and (n, crc) in wanted[doc]
        start += n
    assert len(found) == odd_documents.count()


def test_sequences_have_one_length_and_are_read_in_place(spark, odd_documents):
    import pyarrow as pa

    folder = scratch.new_path(spark, "tokens")
    tokenfiles.write_tokens(spark, odd_documents, folder, JSON, length=64)
    for row in spark.read.format("binaryFile").load(folder).collect():
        batch = tokenfiles.sequences(row["content"])
        assert batch.schema.field("input_ids").type == pa.list_(pa.uint16(), 64) and batch.schema.field("valid").type == pa.list_(pa.bool_(), 64)
        before = pa.total_allocated_bytes()
        with pa.memory_map(row["path"].removeprefix("file:")) as mapped:
            one = tokenfiles.sequences(mapped).column("input_ids")[batch.num_rows // 2].values.to_numpy(zero_copy_only=True)
            assert pa.total_allocated_bytes() - before < 4096
            assert one.tolist() == batch.column("input_ids")[batch.num_rows // 2].as_py()


def test_no_documents(spark, no_documents):
    folder = scratch.new_path(spark, "tokens")
    manifest = tokenfiles.write_tokens(spark, no_documents, folder, JSON)
    assert manifest.count() == 0 and tokenfiles.read_documents(spark, folder, manifest).count() == 0
    assert bpe.round_trip(no_documents, RANKS, P.PATTERN).count() == 0


def test_query_equals_library(spark):
    from helpers import SMALL

    from tarnwick.llm import queries
    from tarnwick.tables import read_table

    library, start, wanted = Tokenizer.from_file(JSON), 0, []
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digests = []
    for r in sorted(read_table(spark, SMALL, "documents").collect(), key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        wanted.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        packed = np.array(other.encode_ordinary(r["text"] or ""), "<u4").tobytes()
        digests.append((r["doc_id"], len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries.op9_tokenfiles(spark, SMALL).collect()) == wanted
    assert sorted(tuple(r) for r in queries.op5_bpe(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == digests
