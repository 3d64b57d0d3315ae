"""Quality classifier: a generalised additive model with pairwise interactions, over counts that describe a text.

Training goes round the features, each in turn adding a shallow tree over its bins to its own lookup table, a small step
at a time (cyclic boosting of the logistic loss); then pairs of features that still explain the residual get tables of
their own in the same way. A score is the intercept plus one table entry per feature and pair, added for all rows at
once. The tables can be read and plotted: ``Model.tables`` has the effect of each bin.

Features of all texts are counted in tasks and never collected. The model is fitted on at most ``SAMPLE_ROWS`` labelled
rows, drawn by a hash of their ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import own, quoted, stored

SAMPLE_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 10
ROUNDS = 200
RATE = 0.1
_RIDGE = 5.0

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "commonest_word", "repeated_pairs", "upper",
    "digit", "stop", "shout", "bar", "markup", "other_ascii", "beyond_ascii", "lines", "line_repeats", "capitalised",
    "one_byte_words", "sentence_words",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_STOP = _class(".,;:")
_SHOUT = _class("!?")
_BAR = _class("|")
_MARKUP = _class("<>{}[]()=/\\&%#$@*_~^+\"")
_OTHER = np.zeros(256, dtype=np.uint8)
_OTHER[0x21:0x7F] = 1
_OTHER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]] = 0
_BEYOND = (np.arange(256) >= 0x80).astype(np.uint8)


def _per_doc(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between the edges."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[edges])


def _distinct(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, count of the commonest) of each text."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n_docs, dtype=np.int64)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(v))))
    return np.bincount(d[at], minlength=n_docs), most


def _features(piece: words.Piece) -> np.ndarray:
    n_docs, buf = len(piece.rows), piece.buf
    size, n = np.diff(piece.offsets).astype(np.float64), piece.n_words.astype(np.float64)
    doc = piece.doc
    length = piece.end - piece.start
    hashes = piece.hashes(fold=True)
    distinct, commonest = _distinct(hashes, doc, n_docs)
    two = piece.run_starts(2)
    pairs, _ = _distinct(piece.runs_at(hashes, two, 2), doc[two], n_docs)
    longest = np.zeros(n_docs)
    np.maximum.at(longest, doc, length)
    letters = _per_doc(((buf | 0x20) >= ord("a")) & ((buf | 0x20) <= ord("z")) | (_BEYOND[buf] == 1), piece.offsets)
    # A line's hash covers its bytes, the end-of-line byte left out.
    at_end, at_start = np.zeros(len(buf) + 1, dtype=bool), np.zeros(len(buf) + 1, dtype=bool)
    at_end[:-1] = at_start[1:] = buf == 0x0A
    at_end[piece.offsets[1:][size > 0]] = at_start[piece.offsets[:-1][size > 0]] = True
    ends, starts = np.flatnonzero(at_end), np.flatnonzero(at_start)
    starts = starts[starts <= (ends[-1] if len(ends) else 0)]
    line_doc = np.searchsorted(piece.offsets, starts, "right") - 1
    full = np.searchsorted(ends, starts)
    keep = full < len(ends)
    starts, line_doc, stops = starts[keep], line_doc[keep], ends[full[keep]]
    keep = stops > starts
    starts, line_doc, stops = starts[keep], line_doc[keep], stops[keep]
    line_hash = words.hash_words(buf, starts, stops, 1)
    lines = np.bincount(line_doc, minlength=n_docs).astype(np.float64)
    line_distinct, _ = _distinct(line_hash, line_doc, n_docs)
    first = buf[piece.start] if len(doc) else np.zeros(0, dtype=np.uint8)
    last = buf[piece.end - 1] if len(doc) else first
    word_sums = [np.bincount(doc, weights=x, minlength=n_docs) for x in (_UPPER[first], length == 1, (last == ord(".")) | (last == ord("!")) | (last == ord("?")))]
    shares = [_per_doc(table[buf], piece.offsets) / np.maximum(size, 1) for table in (_DIGIT, _STOP, _SHOUT, _BAR, _MARKUP, _OTHER, _BEYOND)]
    words_, bytes_ = np.maximum(n, 1), np.bincount(doc, weights=length, minlength=n_docs)
    columns = [
        np.log1p(size), np.log1p(n), bytes_ / words_, longest, distinct / words_, commonest / words_, 1 - pairs / np.maximum(n - 1, 1),
        _per_doc(_UPPER[buf], piece.offsets) / np.maximum(letters, 1), *shares, lines / words_, 1 - line_distinct / np.maximum(lines, 1),
        word_sums[0] / words_, word_sums[1] / words_, n / np.maximum(word_sums[2], 1),
    ]
    out = np.stack(columns, axis=1)
    out[n == 0] = 0
    return out


def text_features(text: Column) -> Column:
    """An array of the FEATURES of a text; a null or blank text has zeros."""

    def describe(texts: pa.Array) -> pa.Array:
        rows = [_features(piece) for piece in words.pieces(texts)]
        table = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, len(FEATURES), dtype=np.int32)), pa.array(table.reshape(-1)))

    return F.arrow_udf(describe, "array<double>")(text.cast("string"))


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]  # of the bins of each feature
    tables: list[np.ndarray]  # effect of each bin, in log-odds
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  # two features, their coarse edges, effects

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[bins[:, j]]
        for a, b, ea, eb, table in self.pairs:
            out += table[np.searchsorted(ea, x[:, a], "right"), np.searchsorted(eb, x[:, b], "right")]
        return out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner borders of bins of about equal counts, between distinct values."""
    values = np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher")) if len(x) else np.zeros(0)
    return values[values > x.min()] if len(x) else values


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + _RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The best tree of up to three leaves over the bins of one feature: its value in each bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    parts = [(0, len(g))]
    for _ in range(2):
        best = None
        for a, b in parts:
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl * _leaf(gl, hl) + (gt - gl) * _leaf(gt - gl, ht - hl) - gt * _leaf(gt, ht)
            at = int(np.argmax(gain))
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0]):
                best = (gain[at], a, a + at + 1, b)
        if best is None:
            break
        _, a, cut, b = best
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
        for x, y in ((a, cut), (cut, b)):
            out[x:y] = _leaf(g[x:y].sum(), h[x:y].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four: (gain, value in each cell)."""
    gs, hs = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    best, out = 0.0, np.zeros_like(g)
    gt, ht = gs[-1, -1], hs[-1, -1]
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            cells = [(gs[i, j], hs[i, j]), (gs[i, -1] - gs[i, j], hs[i, -1] - hs[i, j]), (gs[-1, j] - gs[i, j], hs[-1, j] - hs[i, j])]
            cells.append((gt - sum(c[0] for c in cells), ht - sum(c[1] for c in cells)))
            gain = sum(c[0] * _leaf(*c) for c in cells)
            if gain > best:
                best = gain
                a, b, c, d = (_leaf(*x) for x in cells)
                out = np.full_like(g, d)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1] = a, b, c
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits the model to rows of features and labels 0 and 1. Without rows, or with one label, only the share is learned."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    edges = [_edges(x[:, j], BINS) for j in range(len(FEATURES))]
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [])
    if len(np.unique(y)) < 2:
        return model
    bins = model.bins(x)
    f = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            if len(table) < 2:
                continue
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)))
            table += step
            f += step[bins[:, j]]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(len(FEATURES))]
    coarse_bins = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)], axis=1)

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(coarse_bins[:, a] * shape[1] + coarse_bins[:, b], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((-_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(len(FEATURES)) for b in range(a) if len(coarse[a]) and len(coarse[b])))
    for _, a, b in ranked[:PAIRS]:
        model.pairs.append((a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))))
    for _ in range(ROUNDS // 4):
        for a, b, _, _, table in model.pairs:
            g, h = slopes()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            table += step
            f += step[coarse_bins[:, a], coarse_bins[:, b]]
    return model


def train(features: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from (id, features) and (id, label): rows of null id or of a label other than 0 and 1 are left out.

    An id with several labels counts once for each. At most ``sample_rows`` rows reach the driver.
    """
    told = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    # Label ids are drawn before the join, so what is joined has a fixed size.
    drawn = told.orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows)
    rows = features.select("id", "features").join(drawn, "id").orderBy(F.xxhash64("id"), "id", "y", "features").limit(sample_rows).select("features", "y").collect()
    x = np.array([r["features"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], dtype=np.float64))


def score(model: Model, features: Column) -> Column:
    """The probability of label 1, from an array of features; null features score as zeros."""

    def add(rows: pa.Array) -> pa.Array:
        x = np.zeros((len(rows), len(FEATURES)))
        given = np.asarray(rows.is_valid())
        x[given] = np.asarray(rows.drop_null().flatten()).reshape(-1, len(FEATURES))
        return pa.array(1 / (1 + np.exp(-np.clip(model.log_odds(x), -500, 500))))

    return F.arrow_udf(add, "double")(features)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> tuple[DataFrame, Model]:
    """((id, features, score) of every document, the model); texts are read once, their features kept in the shared folder."""
    described = docs.select(F.col(quoted(id_col)).alias("id"), text_features(F.col(quoted(text_col))).alias("features"))
    described = stored(described, "quality-features")
    model = train(described, labels, id_col, label_col, sample_rows)
    return described.withColumn("score", score(model, F.col("features"))), model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with ``score``, the probability that ``labels`` marks them 1, learned from the labels given.

    Every text is scored, a null or blank one as a text without words. Null ids and ids without a label are scored but
    teach nothing; rows that repeat an id are scored each. Without labels every score is 0.5. An empty table gives an
    empty one. All columns are kept; the new name gets underscores if the table has it already.
    """
    said, features = own(docs, "score", "features")
    _, model = quality_scores(docs, labels, id_col, text_col, **options)
    # The texts are described again instead of joined to what is stored: ids may be null or repeat.
    scored = docs.withColumn(features, text_features(F.col(quoted(text_col))))
    return scored.withColumn(said, score(model, F.col(features))).drop(features)
