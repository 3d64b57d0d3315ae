"""Token counts against the libraries on whole texts."""

import json

import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from datagauge.llm.counts import Counter, _drops_spaces, count_tokens, parts_of, token_counts
from datagauge.llm.queries import QUERIES

from .conftest import prose

WORDS, BYTES, PIECES = (str(path(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "\n", "a", " a b ", "Don't  stop now", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c", "< |endoftext|>", "É́ x ́y", "e ́",
    "日本語 と русский", "12345 6.7", "'s 't '  s", "a\x0bb\x0cc\x1cd e　f\u0085g", "q" * 3000, "x" * 500 + " " + "y" * 500, "Σας ΣΑΣ İ", "🙂 🙂🙂‍", "\x00 \x00",
    " ".join(prose(7, 5000)), "\t".join(prose(8, 300)), " <|endoftext|> ".join(prose(9, 200)),
]


def whole(texts):
    plain = Tokenizer.from_file(WORDS)
    return [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 16), (1, 1), (100, 7), (1 << 18, 40)])
def test_counts_equal_whole_encodings(sizes):
    found = Counter(WORDS)
    assert found.cuts and found.count(iter(TEXTS), *sizes) == whole(TEXTS)


def test_parts_make_up_the_text():
    for text in TEXTS[1:]:
        for most in (1, 5, 1000):
            parts = parts_of(text, most)
            assert "".join(parts) == text and all(p[0] in " \t\n\r" for p in parts[1:])
    assert parts_of("ab cd ef", 1) == ["ab", " cd", " ef"] and parts_of("abcd", 1) == ["abcd"]


def test_other_tokenizers_take_texts_whole():
    plain = Tokenizer.from_file(BYTES)
    found = Counter(BYTES)
    assert not found.cuts and found.count(iter(TEXTS), 50, 5) == [len(plain.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert Counter(PIECES).count(iter(TEXTS), 50, 5) == [len(model.encode(t or "")) for t in TEXTS]


def test_rules_that_keep_spaces_are_told_apart():
    with open(WORDS, encoding="utf-8") as file:
        settings = json.load(file)
    assert _drops_spaces(settings)
    for change in (
        {"pre_tokenizer": None}, {"truncation": {"max_length": 5}}, {"normalizer": {"type": "NFKC"}}, {"added_tokens": [settings["added_tokens"][0] | {"content": "a b"}]},
        {"added_tokens": [settings["added_tokens"][0] | {"lstrip": True}]}, {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": " ?[\\p{L}]+"}, "behavior": "Removed", "invert": True}},
    ):
        assert not _drops_spaces(settings | change)


def test_counts_of_odd_rows(spark, odd_docs, no_docs):
    rows = count_tokens(odd_docs, WORDS, limit=10).collect()
    source = odd_docs.collect()
    expected = sorted((r["doc_id"] or 0, len((r["text"] or "").encode()), n) for r, n in zip(source, whole([r["text"] for r in source])))
    assert sorted((r["id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 10) for r in rows)
    assert count_tokens(no_docs, WORDS).count() == 0
    assert spark.range(1).select(token_counts(F.lit(12), WORDS).alias("n")).first()["n"] == 2


def test_query_equals_the_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_token_counts"](spark, sf_dir).collect()}
    assert got == {r["doc_id"]: (len((r["text"] or "").encode()), n, n > 2048) for r, n in zip(docs, whole([r["text"] for r in docs]))}
