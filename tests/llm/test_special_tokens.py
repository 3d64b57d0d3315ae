"""Texts that hold the content of an added token, against the tokenizer as its file defines it."""

import zlib

import numpy as np
import pyarrow as pa
from public_tokenizers import path
from tokenizers import Tokenizer

from datagauge.llm import words
from datagauge.llm.tokens import Encoder, read_tokens, token_files

TOKENIZER = str(path("byte_bpe_50k.json"))
TEXTS = ["hello <|endoftext|> world", "a<|endoftext|>b c", "<|endoftext|>", "plain words", " <|endoftext|><|endoftext|>  x", "<|endoftext| > no", "plain <|endoftext|>"]


def test_added_tokens_are_matched():
    plain = Tokenizer.from_file(TOKENIZER)
    expected = [e.ids for e in plain.encode_batch(TEXTS, add_special_tokens=False)]
    assert expected[0] == [31373, 220, 50256, 995]
    encode = Encoder(TOKENIZER)
    for limit in (1 << 20, 20, 1 << 20):
        assert [x.tolist() for piece in words.pieces(pa.array(TEXTS), limit) for x in encode(piece)] == expected


def test_token_files_with_added_tokens(spark):
    plain, start, expected = Tokenizer.from_file(TOKENIZER), 0, []
    for i, text in enumerate(TEXTS):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    folder, manifest = token_files(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), TOKENIZER)
    got = read_tokens(spark, folder, manifest, with_ids=False).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected
