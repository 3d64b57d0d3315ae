"""Language of texts: script ranges narrow the languages of a word, Viterbi over word scores labels spans.

A model holds, for every language, the log-probabilities of hashed byte trigrams of words (a word counts with the space
on either side, A-Z folded) and the scripts that its words are written in. It is learned from all labelled texts: each
task adds up tables of a fixed size, and their sum is the model. A word's score is the sum over its trigrams; languages
that do not use the word's script cannot have it; a word without a letter, or of a script that no language has, fits all
alike. A path through the words that pays ``penalty`` for each change of language then gives the spans.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import quoted

BUCKETS = 1 << 16
PENALTY = 8.0
_BATCH_WORDS = 4 << 20
_LEAST_USE = 0.005  # share of a language's words below which a script counts as foreign to it

# First code points of script ranges, and their scripts (0 is no letter, or one of a further script).
_RANGES = (
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00BA, 1), (0x00BB, 0),
    (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1), (0x0300, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4),
    (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0E00, 9), (0x0E80, 0), (0x10A0, 10), (0x1100, 11),
    (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11),
    (0xD7B0, 0), (0xF900, 13), (0xFB00, 0), (0x20000, 13), (0x30000, 0),
)
_NAMED = {
    "LATIN": 1, "FULLWIDTH": 1, "GREEK": 2, "CYRILLIC": 3, "ARMENIAN": 4, "HEBREW": 5, "ARABIC": 6, "DEVANAGARI": 7, "BENGALI": 8,
    "THAI": 9, "GEORGIAN": 10, "HANGUL": 11, "HIRAGANA": 12, "KATAKANA": 12, "HALFWIDTH": 12, "CJK": 13,
}
_LAST_LETTER = 0x32400  # no letters from here on


def _all_ranges() -> tuple[np.ndarray, np.ndarray, int]:
    """First code points of ranges, their scripts, and the number of scripts. Letters that ``_RANGES`` leaves out have the
    script that begins their Unicode name: one of those above, or a further number."""
    named, script = dict(_NAMED), np.zeros(_LAST_LETTER + 1, dtype=np.uint8)
    for (a, kind), (b, _) in zip(_RANGES, (*_RANGES[1:], (_LAST_LETTER, 0))):
        script[a:b] = kind
    for point in np.flatnonzero(script[:-1] == 0).tolist():
        if unicodedata.category(chr(point))[0] == "L":
            script[point] = named.setdefault(unicodedata.name(chr(point), "").split(" ")[0], min(max(named.values()) + 1, 255))
    edges = np.append(0, np.flatnonzero(np.diff(script)) + 1)
    return edges, script[edges], max(named.values()) + 1


_FROM, _SCRIPT, _SCRIPTS = _all_ranges()
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[0x09:0x0E] = 0x20


def _trigrams(piece: words.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte of the piece, BUCKETS outside of words; and the inner starts for sums by word."""
    folded = _FOLD[piece.buf]
    inside = folded != 0x20
    before, after = np.full(len(folded), 0x20, dtype=np.uint32), np.full(len(folded), 0x20, dtype=np.uint32)
    before[1:], after[:-1] = folded[:-1], folded[1:]
    edges = piece.offsets[(piece.offsets > 0) & (piece.offsets < len(folded))]
    before[edges], after[edges - 1] = 0x20, 0x20
    code = (before << np.uint32(16)) | (folded << np.uint32(8)) | after
    code *= np.uint32(0x9E3779B1)
    return np.where(inside, (code >> np.uint32(16)).astype(np.int32), np.int32(BUCKETS)), piece.start


def _scripts(piece: words.Piece) -> np.ndarray:
    """Script of each word: that of its first letter, 0 without one."""
    buf = piece.buf
    script = np.zeros(len(buf), dtype=np.uint8)
    ascii_ = buf < 0x80
    script[ascii_] = (((buf[ascii_] | 0x20) >= ord("a")) & ((buf[ascii_] | 0x20) <= ord("z"))).astype(np.uint8)
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        padded = np.concatenate([buf, np.zeros(3, dtype=np.uint8)]).astype(np.int64)
        b0, b1, b2, b3 = (padded[lead + i] & 0x3F for i in range(4))
        first = padded[lead]
        point = np.where(first < 0xE0, ((first & 0x1F) << 6) | b1, np.where(first < 0xF0, ((first & 0x0F) << 12) | (b1 << 6) | b2, ((first & 0x07) << 18) | (b1 << 12) | (b2 << 6) | b3))
        script[lead] = _SCRIPT[np.searchsorted(_FROM, point, "right") - 1]
    letters = np.flatnonzero(script)
    nth = np.searchsorted(letters, piece.start)
    has = nth < np.searchsorted(letters, piece.end)
    out = np.zeros(len(piece.start), dtype=np.uint8)
    out[has] = script[letters[nth[has]]]
    return out


@dataclass
class Model:
    languages: list[str]  # in code point order
    scores: np.ndarray  # (languages, BUCKETS + 1): log-probabilities, 0 at the end
    uses: np.ndarray  # (languages, _SCRIPTS): whether the language uses the script
    usual: int  # the language with the most words


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows with a text and a language. What reaches the driver is one table for each language."""
    rows = docs.select(F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(text_col)).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            names, codes = codes.dictionary.to_pylist(), np.asarray(codes.indices)
            for piece in words.pieces(batch.column(1)):
                buckets, scripts = _trigrams(piece)[0], _scripts(piece)
                of_doc = codes[piece.rows]
                of_byte, of_word = np.repeat(of_doc, np.diff(piece.offsets)), of_doc[piece.doc]
                for code in np.unique(of_doc):
                    table = tables.setdefault(names[code], np.zeros(BUCKETS + 1 + _SCRIPTS, dtype=np.int64))
                    table[: BUCKETS + 1] += np.bincount(buckets[of_byte == code], minlength=BUCKETS + 1)
                    table[BUCKETS + 1 :] += np.bincount(scripts[of_word == code], minlength=_SCRIPTS)
        for name, table in tables.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name]), "counts": pa.array([table.tobytes()], pa.binary())})

    def add(key, table):
        total = sum(np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column("counts"))
        return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([total.tobytes()], pa.binary())})

    summed = rows.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()
    tables = {r["lang"]: np.frombuffer(bytes(r["counts"]), dtype=np.int64) for r in summed}
    languages = sorted(tables)
    scores, uses, n_words = np.zeros((len(languages), BUCKETS + 1)), np.zeros((len(languages), _SCRIPTS), dtype=bool), []
    for i, name in enumerate(languages):
        seen, scripts = tables[name][:BUCKETS], tables[name][BUCKETS + 1 :]
        scores[i, :BUCKETS] = np.log((seen + 0.5) / (seen.sum() + 0.5 * BUCKETS))
        uses[i] = scripts > _LEAST_USE * max(1, scripts[1:].sum())
        n_words.append(int(scripts.sum()))
    return Model(languages, scores.astype(np.float32), uses, int(np.argmax(n_words)) if n_words else 0)


def _word_scores(model: Model, piece: words.Piece) -> tuple[np.ndarray, np.ndarray]:
    """(scores less the best of the word, whether the word tells anything) of the words of a piece."""
    n, m = len(piece.start), len(model.languages)
    if not n:
        return np.zeros((0, m), dtype=np.float32), np.zeros(0, dtype=bool)
    buckets, starts = _trigrams(piece)
    out = np.empty((n, m), dtype=np.float32)
    for i in range(m):
        out[:, i] = np.add.reduceat(model.scores[i][buckets], starts)
    script = _scripts(piece)
    fits = model.uses.T[script]
    known = (script > 0) & fits.any(axis=1)
    out[~fits] = -np.inf
    out[~known] = 0
    return out - out.max(axis=1, keepdims=True), known


def _paths(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word: all texts go one word further at a time, longest texts first."""
    n = np.diff(first)
    m = scores.shape[1]
    came = np.zeros(scores.shape, dtype=np.int8 if m < 128 else np.int16)
    path = np.zeros(len(scores), dtype=came.dtype)
    order = np.argsort(-n, kind="stable")
    begin, sorted_n = first[:-1][order], n[order]
    longest = int(sorted_n[0]) if len(n) else 0
    active = np.searchsorted(-sorted_n, -np.arange(1, longest + 1), "right")  # texts with more than t words
    state = np.zeros((len(n), m), dtype=np.float32)
    each = np.arange(m, dtype=came.dtype)
    for t in range(longest):
        a = active[t]
        now, at = state[:a], begin[:a] + t
        best = now.argmax(axis=1)
        top = now[np.arange(a), best] - np.float32(penalty)
        change = now < top[:, None]
        came[at] = np.where(change, best[:, None].astype(came.dtype), each)
        np.maximum(now, top[:, None], out=now)
        now += scores[at]
    # The last word's best state, then back along the way it came.
    last = state.argmax(axis=1).astype(came.dtype) if len(n) else np.zeros(0, dtype=came.dtype)
    for t in range(longest - 1, -1, -1):
        at = begin[: active[t]] + t
        path[at] = last[: active[t]]
        last[: active[t]] = came[at, last[: active[t]]]
    return path


def label_languages(model: Model, text: Column, penalty: float = PENALTY, with_spans: bool = True) -> Column:
    """A struct of lang, score and spans (first word, end, lang) for a text column.

    lang is the language of the most words that tell anything, score their share (0 to 1). Spans cover all words. A null
    or blank text, or one without any letter, has ``und``, 0 and no span; so has every text under a model without
    languages. Letters of unknown scripts alone give the usual language with a score of 0.
    """
    shared = None if not model.languages else model

    def label(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        lettered = np.asarray(lettered.fill_null(False))
        lang, said = np.full(len(texts), -1), np.zeros(len(texts))
        spans: list = [None] * len(texts)
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size
            scores, known = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            rows, n = np.concatenate([h[0].rows for h in held]), np.concatenate([h[0].n_words for h in held])
            first = np.append(0, np.cumsum(n))
            path = _paths(scores, first, penalty)
            doc = np.repeat(np.arange(len(n)), n)
            m = len(shared.languages)
            votes = np.bincount(doc[known] * m + path[known], minlength=len(n) * m).reshape(len(n), m)
            total = votes.sum(axis=1)
            lang[rows] = np.where(total > 0, votes.argmax(axis=1), shared.usual)
            said[rows] = votes.max(axis=1) / np.maximum(total, 1)
            if with_spans:
                for d, row in enumerate(rows):
                    own_path = path[first[d] : first[d + 1]]
                    cut = np.flatnonzero(np.diff(own_path)) + 1
                    starts = [0, *cut.tolist()] if len(own_path) else []
                    spans[row] = [{"start": a, "end": b, "lang": shared.languages[own_path[a]]} for a, b in zip(starts, [*starts[1:], len(own_path)])]
            held, size = [], 0

        if shared is not None:
            for piece in words.pieces(texts):
                held.append((piece, *_word_scores(shared, piece)))
                size += len(piece.start)
                if size >= _BATCH_WORDS:
                    flush()
            if held:
                flush()
        lang[~lettered], said[~lettered] = -1, 0
        names = [*(shared.languages if shared else []), "und"]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        shown = pa.array([s if s and ok else [] for s, ok in zip(spans, lettered)], kind)
        return pa.StructArray.from_arrays([pa.array([names[i] for i in lang], pa.string()), pa.array(said), shown], names=["lang", "score", "spans"])

    kind = "struct<lang: string, score: double, spans: array<struct<start: long, end: long, lang: string>>>"
    return F.arrow_udf(label, kind)(text.cast("string"), F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False)))
