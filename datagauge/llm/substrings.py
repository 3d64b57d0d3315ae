"""Substring dedup by level-wise doubling: passages of at least ``window`` words that occur more than once.

The levels are ``window`` halved twice, rounded up (9, 18 and 35 words by default). A window that repeats contains a
repeating half, which contains a repeating quarter, so a level only reads what the level before found to repeat.

* Every window picks one anchor: the quarter-length run of least hash among those of its first half (the first of
  equals). Equal windows pick the same anchor at the same place, so only anchors, about one word in ten, need counting
  at the first level, and nothing that repeats is lost.
* Anchors that occur once are dropped; the others are extended to twice their length and counted again.
* Windows of the anchors left are compared at full length by 128 bits of hash. Those found twice are the result, and
  their words are covered. The loop ends early when no anchor is left.

Texts with the same word sequence are compared through one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .shared import own, quoted, stored

WINDOW = 35


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of ``values[i : i + width]`` for every i, the first of equals; the array ends ``width - 1`` earlier."""
    at, span = np.arange(len(values)), 1
    low = values
    while span < width:
        step = min(span, width - span)
        a, b = low[:-step], low[step:]
        right = b < a
        at, low = np.where(right, at[step:], at[:-step]), np.where(right, b, a)
        span += step
    return at


def _anchors(piece: words.Piece, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows, anchor of each), as word positions in the piece."""
    starts = piece.run_starts(window)
    if not len(starts):
        return starts, starts
    half = -(-window // 2)
    quarter = -(-half // 2)
    count = len(hashes) - quarter + 1
    values = piece.runs_at(hashes, np.arange(count), quarter)
    return starts, _least(values, window - half + 1)[starts]


def _scan(texts: DataFrame, window: int) -> DataFrame:
    """(k1, k2, f1, f2, n, anchors) of each text; an anchor has its first word and its hashes at the first two levels."""
    half = -(-window // 2)
    quarter = -(-half // 2)

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for piece in words.pieces(batch.column(2)):
                hashes, first, n = piece.hashes(fold=False), piece.first, piece.n_words
                f = []
                for second in (False, True):
                    part = np.zeros(len(n), dtype=np.uint64)
                    some = np.flatnonzero(n)
                    part[some] = words._runs(hashes, first[:-1][some], first[1:][some], words._BASES[second])
                    f.append(part.view(np.int64))
                _, anchors = _anchors(piece, hashes, window)
                at = anchors[np.flatnonzero(np.diff(anchors, prepend=-1))]
                doc = piece.doc[at]
                ends = np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
                    for x in ((at - first[:-1][doc]).astype(np.int64), piece.runs_at(hashes, at, quarter).view(np.int64), piece.runs_at(hashes, at, half).view(np.int64))
                ]
                keys = [batch.column(c).take(pa.array(piece.rows)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, f), pa.array(n, pa.int64()), *lists], names=["k1", "k2", "f1", "f2", "n", "at", "quarter", "half"])

    return texts.mapInArrow(scan, "k1 long, k2 long, f1 long, f2 long, n long, at array<long>, quarter array<long>, half array<long>")


def _windows(rows: DataFrame, row: str, ats: str, text: str, window: int) -> DataFrame:
    """(row, s, a, b): the windows whose anchors are in the column ``ats``, with 128 bits of hash."""
    at_row, at_ats, at_text = (rows.columns.index(c) for c in (row, ats, text))

    def build(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column(at_ats)
            for piece in words.pieces(batch.column(at_text)):
                hashes = piece.hashes(fold=False)
                starts, anchors = _anchors(piece, hashes, window)
                mine = lists.slice(piece.rows[0], len(piece.rows))
                size = np.diff(np.asarray(mine.offsets))
                wanted = np.asarray(mine.flatten()) + np.repeat(piece.first[:-1], size)
                marked = np.zeros(len(hashes) + 1, dtype=bool)
                marked[wanted] = True
                starts = starts[marked[anchors]]
                doc = piece.doc[starts]
                own_row = batch.column(at_row).take(pa.array(piece.rows[doc]))
                a, b = (piece.runs_at(hashes, starts, window, second) for second in (False, True))
                columns = [own_row, pa.array(starts - piece.first[:-1][doc], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(_spread(a, b), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "s", "a", "b", "salt"])

    return rows.mapInArrow(build, "row long, s long, a long, b long, salt long")


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of windows or anchors with the same two hashes, -1 for the first and 1, 2, .. for the others; 0 for single ones.

    They are those of one batch. The first stands for all of them elsewhere, so a passage that many texts share is one row
    of its key for each batch.
    The others repeat for certain and are dealt out by their salt.
    """
    salt = np.zeros(len(a), dtype=np.int64)
    if len(a):
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        salt[order[1:][same]] = np.arange(1, int(same.sum()) + 1)
        first = np.append(same, False) & ~np.append(False, same)
        salt[order[first]] = -1
    return salt


def _dealt(lists: DataFrame) -> DataFrame:
    """(row, at, quarter, half, s1, s2): one row for each anchor, with salts for both levels, dealt in each batch."""

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            size = np.diff(np.asarray(batch.column(1).offsets))
            at, quarter, half = (np.asarray(batch.column(i).flatten()) for i in (1, 2, 3))
            salts = [pa.array(_spread(x.view(np.uint64), np.zeros(len(x), dtype=np.uint64)).astype(np.int32)) for x in (quarter, half)]
            columns = [pa.array(np.repeat(np.asarray(batch.column(0)), size)), *map(pa.array, (at, quarter, half)), *salts]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "at", "quarter", "half", "s1", "s2"])

    return lists.select("row", "at", "quarter", "half").mapInArrow(deal, "row long, at long, quarter long, half long, s1 int, s2 int")


def _repeats(df: DataFrame, salt: str, *keys: str) -> DataFrame:
    """The rows whose key another row has as well, given the salt that ``_spread`` deals out."""
    dealt = df.withColumn("key", F.greatest(F.col(salt), F.lit(0)))
    times = F.count("*").over(Window.partitionBy(*keys, "key"))
    return dealt.withColumn("times", times).where(f"times > 1 OR {salt} <> 0").drop("times", "key", salt, *keys)


def _cut(window: int):
    """A struct of n_words, n_removed and the kept text, from the text, the starts of its repeated windows and whether all goes."""

    def cut(texts: pa.Array, starts: pa.Array, whole: pa.Array) -> pa.Array:
        n_words, n_removed, kept = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), []
        whole = np.asarray(whole.fill_null(False))
        for piece in words.pieces(texts):
            n_words[piece.rows] = piece.n_words
            for d, row in enumerate(piece.rows):
                n, found = int(piece.n_words[d]), starts[row].values
                if whole[row]:
                    n_removed[row] = n
                    kept.append(b"")
                    continue
                said = piece.text(d).split()
                if found is not None and len(found):
                    change = np.zeros(n + 1, dtype=np.int64)
                    at = np.asarray(found)
                    change[at] += 1
                    np.subtract.at(change, at + window, 1)
                    stay = np.cumsum(change[:-1]) == 0
                    n_removed[row] = n - int(stay.sum())
                    said = compress(said, stay)
                kept.append(b" ".join(said))
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["n_words", "n_removed", "kept"])

    return F.arrow_udf(cut, "struct<n_words: long, n_removed: long, kept: string>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with n_words, n_removed and kept_text: their words outside all repeated windows, joined by a space.

    Words are runs of bytes other than ASCII white space, compared unchanged. A window is ``window`` consecutive words of
    one text; it repeats if its words also start anywhere else, in another row or in the same text. All occurrences go,
    judged on the input. Null texts and texts without words give 0, 0 and an empty string; texts with fewer words than a
    window lose nothing; rows that repeat a text of at least ``window`` words lose it all, whatever their ids, which may
    be null or repeat. An empty table gives an empty one. All columns are kept; new names get underscores if the table
    has them already.
    """
    if window < 4:
        raise ValueError("a window has at least four words")
    k1, k2, n_words, n_removed, kept, starts, whole, cut = own(docs, "k1", "k2", "n_words", "n_removed", "kept_text", "starts", "whole", "cut")
    row, ats = own(docs, "row", "ats")
    text = F.col(quoted(text_col)).cast("string")
    # A row is known by 128 bits of hash of its text and id; rows that agree in both are alike.
    keyed = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.col(quoted(id_col)), F.crc32(text.cast("binary")), F.length(text))})
    texts = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), text.alias("text"))
    scanned = stored(_scan(texts, window), "substring-scan")

    # One row for each word sequence stands for its copies; copies of a whole window or more go altogether.
    classes = scanned.where(F.col("n") >= window).groupBy("f1", "f2", "n").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2")).alias("least"))
    classes = stored(classes.withColumn("row", F.monotonically_increasing_id()), "substring-classes")
    copied = scanned.join(classes.where("copies > 1").select("f1", "f2", "n"), ["f1", "f2", "n"], "left_semi").select("k1", "k2").distinct()

    lists = scanned.join(classes.select("row", "f1", "f2", "n", F.col("least.k1").alias("k1"), F.col("least.k2").alias("k2")), ["f1", "f2", "n", "k1", "k2"])
    level = _repeats(_dealt(lists), "s1", "quarter")
    survivors = _repeats(level, "s2", "half").groupBy("row").agg(F.collect_set("at").alias("ats"))
    survivors = survivors.join(classes.select("row", "least"), "row").select("row", F.col("least.k1").alias("k1"), F.col("least.k2").alias("k2"), "ats")
    survivors = stored(survivors, "substring-survivors")

    # Both joins below read the texts with the same columns and keys, so one shuffle of them serves both.
    wanted = survivors.select(F.col("row").alias(row), F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("ats").alias(ats))
    found = _repeats(_windows(keyed.join(wanted, [k1, k2]), row, ats, text_col, window), "salt", "a", "b")
    covered = found.groupBy("row").agg(F.collect_set("s").alias("starts")).join(survivors.select("row", "k1", "k2"), "row").select("k1", "k2", "starts")
    plan = covered.join(copied.withColumn("whole", F.lit(True)), ["k1", "k2"], "full").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("starts").alias(starts), F.col("whole").alias(whole))
    done = keyed.join(plan, [k1, k2], "left").withColumn(cut, _cut(window)(text, F.col(starts), F.col(whole)))
    columns = [F.col(quoted(c)) for c in docs.columns]
    return done.select(*columns, *[F.col(f"{cut}.{a}").alias(b) for a, b in (("n_words", n_words), ("n_removed", n_removed), ("kept", kept))])
