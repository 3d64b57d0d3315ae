"""Token counts of whole texts by a tokenizer file, without keeping the tokens.

A task hands the tokenizer batches of about equal bytes, whatever the lengths of the texts, and keeps the lengths of what
comes back. A long text is cut at places where the tokenizer's own rules cut as well, so its parts are counted one after
the other and their counts add up. Such a place stands before an ASCII white space, if the tokenizer is known to end a
word there and to drop the space; for other tokenizers, texts stay whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import quoted

BATCH_BYTES = 1 << 18
LONG_BYTES = 1 << 16
_SPACE = re.compile(r"[ \t\n\r]")


def _drops_spaces(settings: dict) -> bool:
    """Whether a tokenizer file's rules make every white space end a word and vanish.

    Known for this form: a normalizer of NFC, of white space to one space and of lower case, letter by letter; a split
    that keeps the matches of a pattern none of which holds white space; no rule after it that joins words, no added
    token that holds white space or takes that beside it; nothing put before or after a text.
    """
    steps = lambda part, name: (part or {}).get(name) or [part] if part else []
    normal = steps(settings.get("normalizer"), "normalizers")
    split = steps(settings.get("pre_tokenizer"), "pretokenizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for n in normal)
    first = split[0] if split else {}
    # A pattern of runs of letters or digits, of what is neither nor white space, and of fixed endings.
    parts = first.get("pattern", {}).get("Regex", " ").split("|")
    spaceless = all(re.fullmatch(r"'[a-z]+|\[?\\p\{[LN]\}\]?\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+", p) for p in parts)
    cut = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and spaceless
    rest = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in split[1:])
    added = all(not (_SPACE.search(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in settings.get("added_tokens") or [])
    return plain and cut and rest and added and not settings.get("truncation") and not settings.get("padding") and settings["model"].get("dropout") is None


def parts_of(text: str, most: int) -> list[str]:
    """The text cut before ASCII white space into parts of about ``most`` characters; longer ones where none stands."""
    out, a = [], 0
    while len(text) - a > most:
        found = _SPACE.search(text, a + most)
        if not found:
            break
        out.append(text[a : found.start()])
        a = found.start()
    out.append(text[a:])
    return out


class Counter:
    """Numbers of tokens of texts by one tokenizer file, of the tokenizers (.json) or sentencepiece (.model) library."""

    def __init__(self, path: str):
        # A task has one core; threads of its own would each keep memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
        else:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as file:
                self.cuts = _drops_spaces(json.load(file))
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: Iterator[str | None], batch_bytes: int = BATCH_BYTES, long_bytes: int = LONG_BYTES) -> list[int]:
        """Tokens of every text; a null counts as empty."""
        totals: list[int] = []
        batch: list[str] = []
        owner: list[int] = []
        size = 0

        def flush():
            nonlocal batch, owner, size
            for i, n in zip(owner, self.lengths(batch) if batch else []):
                totals[i] += n
            batch, owner, size = [], [], 0

        for text in texts:
            totals.append(0)
            if not text:
                continue
            for part in parts_of(text, long_bytes) if self.cuts else [text]:
                batch.append(part)
                owner.append(len(totals) - 1)
                size += len(part)
                if size >= batch_bytes:
                    flush()
        flush()
        return totals


@functools.cache
def counter(path: str) -> Counter:
    """The counter of this process."""
    return Counter(path)


def token_counts(text: Column, tokenizer: str, batch_bytes: int = BATCH_BYTES, long_bytes: int = LONG_BYTES) -> Column:
    """The number of tokens of a text column, a long; a null or empty text has none.

    Counts are the library's for the whole text: no begin, end or other token is put beside it, the strings of special
    tokens inside it are handled as the library does by itself, nothing is truncated or padded. ``tokenizer`` is a file
    that every executor has. Memory follows ``batch_bytes`` and the longest part: a text of any length is cut at white
    space where the file's rules allow it, and a text without any goes through as one.
    """

    @arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        found = counter(tokenizer)
        return pa.array(found.count((x.as_py() for x in column), batch_bytes, long_bytes), pa.int64())

    return count(text.cast("string"))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: UTF-8 bytes, tokens, whether these exceed ``limit``.

    Null and empty texts have neither. Repeated rows and null ids each give a row, an empty table an empty one; other
    columns are ignored.
    """
    text = F.col(quoted(text_col)).cast("string")
    out = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), token_counts(text, tokenizer).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
