"""Added tokens in texts: op9 against the library's defaults."""

import zlib

import numpy as np
import public_tokenizers as P
from test_tokens import odd_texts
from tokenizers import Tokenizer

from tarnwick.llm import queries, tokenfiles

JSON = P.path("byte_bpe_50k.json")


def test_encoder_equals_library_defaults():
    library = Tokenizer.from_file(JSON)
    texts = [*odd_texts(), "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x<|endoftext|>y"]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenfiles.LibraryEncoder(JSON).texts([t.encode() for t in texts])] == wanted


def test_query_finds_added_tokens(spark, tmp_path):
    rows = [(1, "plain text"), (2, "a <|endoftext|> b"), (3, "after it"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library, wanted, start = Tokenizer.from_file(JSON), [], 0
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        wanted.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op9_tokenfiles(spark, str(tmp_path)).collect()) == wanted
