"""Benchmark decontamination: item-sized windows by SimHash, candidates by multi-index Hamming blocks, exact verification.

A window has as many words as an item. Its 5-word shingles are a bag; a shingle weighs log(1 + items / items that have
it), one that no item has weighs the most. The 64-bit SimHash of the weighted bag is cut into four blocks of 16 bits. Two
fingerprints within ``radius`` bits agree within ``radius // 4`` bits in some block, so a table of all such neighbours
of the items' blocks finds every item within the radius. Found pairs are verified by sum(w * min) / sum(w * max).

The SimHash sums signs times sqrt(w * count). Then two bags of similarity J have a cosine of at least 2J / (1 + J), whatever
the weights: the product is sum(w * sqrt(x * y)) >= sum(w * min), the norms' at most half of sum(w * x) + sum(w * y). At
0.8 that is 8/9, and a bit differs with a chance of at most acos(8/9) / pi = 0.151: 9.7 of 64 on average.

Only windows whose shingles of the benchmark weigh at least the threshold's share of the window are fingerprinted:
others cannot reach it. Equal item texts count as often as they occur, but are searched once. Distinct texts go to all
tasks in slices of about ``ITEMS_PER_SLICE``, one scan of the documents for each slice. Frequencies are counted once over
all items and are the same in every slice; those of shingles that two or more items have, 16 bytes each, are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import own, quoted, stored

RADIUS = 19
ITEMS_PER_SLICE = 1000
_BLOCKS = 4
_BITS = 1 << np.arange(16, dtype=np.int64)
_SLACK = 1e-9


def _near(radius: int) -> np.ndarray:
    """All 16-bit masks with at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(16), n)], dtype=np.uint16)


def _signs(values: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    raw = words.mix(values).astype("<u8").view(np.uint8).reshape(len(values), 8)
    return np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")[:, 0]


def _shingle_at(piece: words.Piece, hashes: np.ndarray, d: int, k: int) -> np.ndarray:
    """The k-word shingles of a text in order; those under five words are marked by their length."""
    a, b = piece.first[d], piece.first[d + 1]
    return _marked(words._runs(hashes[a:b], np.arange(b - a - k + 1), np.arange(k, b - a + 1), words._BASES[0]), k)


def _marked(values: np.ndarray, k: int, full: int = 5) -> np.ndarray:
    return values if k == full else words.mix(values + np.uint64(k))


@dataclass
class Index:
    """The items of a slice, by their number of words."""

    ids: list
    bags: list[tuple[np.ndarray, np.ndarray]]  # shingles and counts of each item
    sizes: np.ndarray
    shingles: np.ndarray
    weights: np.ndarray
    heaviest: float
    radius: int
    common: tuple[np.ndarray, np.ndarray] | None = None  # shingles of several items of any slice, sorted, and their weights
    tables: dict[int, list] = field(default_factory=dict)

    def weigh(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, whether an item has it) of each shingle."""
        at = np.searchsorted(self.shingles, values)
        at[at == len(self.shingles)] = 0
        known = self.shingles[at] == values
        weight = np.where(known, self.weights[at], self.heaviest)
        if self.common is not None and len(self.common[0]):
            at = np.searchsorted(self.common[0], values)
            at[at == len(self.common[0])] = 0
            weight = np.where(self.common[0][at] == values, self.common[1][at], weight)
        return weight, known

    def prepare(self) -> None:
        """Fingerprints and block tables, built by the process that needs them."""
        masks = _near(self.radius // _BLOCKS)
        for size in np.unique(self.sizes):
            mine = np.flatnonzero(self.sizes == size)
            prints = np.concatenate([_packed((_signs(v) * np.sqrt(self.weigh(v)[0] * c)[:, None]).sum(axis=0, keepdims=True)) for v, c in (self.bags[i] for i in mine)])
            blocks = prints.view("<u2").reshape(len(mine), _BLOCKS)
            table = []
            for b in range(_BLOCKS):
                keys = (blocks[:, b : b + 1] ^ masks[None, :]).reshape(-1)
                order = np.argsort(keys, kind="stable")
                table.append((keys[order], np.repeat(np.arange(len(mine)), len(masks))[order]))
            self.tables[int(size)] = [mine, prints, table]

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(print, item) of every pair within the radius."""
        mine, own_prints, table = self.tables[size]
        left, right = [], []
        for b, (keys, items) in enumerate(table):
            values = prints.view("<u2").reshape(len(prints), _BLOCKS)[:, b]
            a, z = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
            n = z - a
            left.append(np.repeat(np.arange(len(prints)), n))
            right.append(items[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        pairs = np.unique(np.concatenate(left) * len(mine) + np.concatenate(right))
        left, right = pairs // len(mine), pairs % len(mine)
        near = np.bitwise_count(prints[left] ^ own_prints[right]) <= self.radius
        return left[near], mine[right[near]]


def _frequencies(items: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two or more items have, sorted, and how many have them, from (text, copies) of distinct texts."""

    def count(batches):
        for batch in batches:
            copies = np.asarray(batch.column(1))
            for piece in words.pieces(batch.column(0)):
                hashes = piece.hashes(fold=True)
                for d in np.flatnonzero(piece.n_words):
                    values = np.unique(_shingle_at(piece, hashes, d, min(k, int(piece.n_words[d]))))
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.full(len(values), copies[piece.rows[d]]))], names=["shingle", "n"])

    counted = items.select("text", "copies").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    shingles, n = (counted.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(shingles.view(np.uint64))
    return shingles.view(np.uint64)[order], n[order]


def build_index(items: list[tuple], k: int, radius: int, heaviest_of: int, common: tuple[np.ndarray, np.ndarray] | None = None) -> Index:
    """The index of (id, text) items; items without words are left out. ``heaviest_of`` is the number of all items.
    ``common`` tells the frequencies of shingles that several items have; without it they are counted in these items."""
    texts = pa.array([t for _, t in items], pa.string())
    ids, bags, sizes = [], [], []
    for piece in words.pieces(texts):
        hashes = piece.hashes(fold=True)
        for d, row in enumerate(piece.rows):
            n = int(piece.n_words[d])
            if n:
                ids.append(items[row][0])
                bags.append(np.unique(_shingle_at(piece, hashes, d, min(k, n)), return_counts=True))
                sizes.append(n)
    shingles, frequency = np.unique(np.concatenate([b[0] for b in bags]), return_counts=True) if bags else (np.zeros(1, np.uint64), np.ones(1))
    if common is not None:
        frequency = np.ones(len(shingles))
        _, here, there = np.intersect1d(shingles, common[0], assume_unique=True, return_indices=True)
        frequency[here] = common[1][there]
    weights = np.log1p(heaviest_of / frequency)
    return Index(ids, bags, np.array(sizes, dtype=np.int64), shingles, weights, float(np.log1p(heaviest_of)), radius)


def _similarity(index: Index, values: np.ndarray, item: int) -> float:
    """Weighted Jaccard similarity of two bags."""
    a, a_n = np.unique(values, return_counts=True)
    b, b_n = index.bags[item]
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)], y[np.searchsorted(every, b)] = a_n, b_n
    w = index.weigh(every)[0]
    return float((w * np.minimum(x, y)).sum() / (w * np.maximum(x, y)).sum())


def _prints(values: np.ndarray, weight: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Fingerprints of the windows of ``count`` shingles from each start."""
    signs, root = _signs(values), np.sqrt(weight)
    run = np.zeros((len(values) + 1, 64), dtype=np.float64)
    np.cumsum(signs * root[:, None], axis=0, out=run[1:])
    sums = run[starts + count] - run[starts]
    # A window repeats a shingle if one of its places has the last earlier place of the same shingle inside as well.
    order = np.argsort(values, kind="stable")
    again = np.flatnonzero(values[order[1:]] == values[order[:-1]])
    earlier, later = order[again], order[again + 1]
    near = later - earlier < count
    first, last = np.maximum(later[near] - count + 1, 0), earlier[near]
    edges = np.bincount(first, minlength=len(values) + 1) - np.bincount(last + 1, minlength=len(values) + 1)
    for i in np.flatnonzero(np.cumsum(edges)[starts] > 0):
        _, at, n = np.unique(values[starts[i] : starts[i] + count], return_index=True, return_counts=True)
        at, n = at[n > 1] + starts[i], n[n > 1]
        sums[i] += (signs[at] * (root[at] * (np.sqrt(n) - n))[:, None]).sum(axis=0)
    return _packed(sums)


def _leaks(index: Index, shingles: dict[int, np.ndarray], n_words: int, k: int, threshold: float) -> list[tuple]:
    """(item, first word, words, similarity) of the best window of each item that a text holds."""
    best: dict[int, tuple] = {}
    sums: dict[int, tuple] = {}
    for size in map(int, np.unique(index.sizes)):
        window = min(size, n_words)
        kind = min(size, k)
        if window < kind:
            continue
        values = shingles[kind]
        if kind not in sums:
            weight, known = index.weigh(values)
            sums[kind] = tuple(np.concatenate([[0.0], np.cumsum(x)]) for x in (weight, weight * known)) + (weight,)
        all_, hit, weight = sums[kind]
        count = window - kind + 1
        total, of_items = all_[count:] - all_[:-count], hit[count:] - hit[:-count]
        starts = np.flatnonzero(of_items >= threshold * total - _SLACK)
        if not len(starts):
            continue
        a, b = starts[0], starts[-1] + count
        prints = _prints(values[a:b], weight[a:b], starts - a, count)
        which, item = index.candidates(size, prints)
        for i in np.unique(item):
            at = starts[which[item == i]]
            member = np.isin(values[a:b], index.bags[i][0]) * weight[a:b]
            shared = np.concatenate([[0.0], np.cumsum(member)])
            most = shared[at - a + count] - shared[at - a]
            whole = float((index.weigh(index.bags[i][0])[0] * index.bags[i][1]).sum())
            most = np.minimum(most, whole)
            bound = most / (total[at] + whole - most)
            # Best bound first; what follows cannot be better than a similarity already found.
            for j in np.lexsort((at, -bound)):
                if bound[j] < max(threshold, best.get(i, (0, 0, 0.0))[2]) - _SLACK:
                    break
                said = _similarity(index, values[at[j] : at[j] + count], i)
                if said >= threshold - _SLACK and said > best.get(i, (0, 0, 0.0))[2]:
                    best[i] = (int(at[j]), window, said)
    return [(index.ids[i], *found) for i, found in best.items()]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the best window of each item in each document that holds it.

    Words are runs of bytes other than ASCII white space, A-Z folded; start counts words from 0. An item or text of
    fewer words than a shingle is one shingle; a text shorter than an item is one window. Null or blank texts and items
    hold nothing. Ids are passed on as they are, null or repeated; every row of the documents is searched,
    in texts of any length: memory follows the words between a text's first and last window that may match, some 770
    bytes each. Empty tables give an empty one. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string"))
    items = benchmark.select(F.col(quoted(item_id)).alias("item_id"), F.col(quoted(item_text)).cast("string").alias("text"))
    items = items.withColumn("item", F.sha2(F.col("text").cast("binary"), 256))
    n_items = items.count()
    distinct = stored(items.where("item IS NOT NULL").groupBy("item").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "items")
    slices = max(1, -(-distinct.count() // ITEMS_PER_SLICE))
    common = _frequencies(distinct, k)
    shared = docs.sparkSession.sparkContext.broadcast((common[0], np.log1p(n_items / common[1])))
    schema = f"doc_id {kind}, item string, start long, n_words long, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for nth in range(slices):
        part = distinct.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == nth).select("item", "text").collect()
        index = build_index([(r["item"], r["text"]) for r in part], k, radius, n_items, common)
        if index.ids:
            out = out.union(_scan(texts, index, shared, k, threshold, schema))
    return out.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "start", "n_words", "similarity")


def _scan(texts: DataFrame, index: Index, common, k: int, threshold: float, schema: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(index)  # about ITEMS_PER_SLICE items
    short = sorted({int(s) for s in index.sizes if s < k})

    def scan(batches):
        own_index = shared.value
        own_index.common = common.value
        if not own_index.tables:
            own_index.prepare()
        # A bit for each residue of the items' shingles keeps most lookups away from the sorted list.
        seen = np.zeros(1 << 20, dtype=bool)
        seen[(own_index.shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            rows, found = [], []
            for piece in words.pieces(batch.column(1)):
                hashes = piece.hashes(fold=True)
                hit = np.zeros(len(piece.rows), dtype=bool)
                for kind in (*short, k):
                    at = piece.run_starts(kind)
                    values = _marked(piece.runs_at(hashes, at, kind), kind, k)
                    maybe = np.flatnonzero(seen[(values & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    maybe = maybe[own_index.weigh(values[maybe])[1]]
                    hit[piece.doc[at[maybe]]] = True
                for d in np.flatnonzero(hit):
                    n = int(piece.n_words[d])
                    by_kind = {kind: _shingle_at(piece, hashes, d, kind) for kind in (*short, k) if n >= kind}
                    for leak in _leaks(own_index, by_kind, n, k, threshold):
                        rows.append(piece.rows[d])
                        found.append(leak)
            if rows:
                item, start, size, said = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(item, pa.string()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(said, pa.float64())],
                    names=["doc_id", "item", "start", "n_words", "similarity"],
                )

    return texts.mapInArrow(scan, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with all their columns. Each row is judged by its own text, which the leaks are
    joined by as SHA-256; ids, null or repeated, play no part. Null, blank and clean rows stay as often as they occur; an empty table gives an
    empty one; any column names are kept."""
    (gone,) = own(docs, "gone")
    digest = F.sha2(docs[quoted(text_col)].cast("string").cast("binary"), 256)
    texts = docs.select(digest.alias(gone), F.col(quoted(text_col)).alias(own(docs, "text")[0]))
    leaks = find_leaks(texts, benchmark, gone, texts.columns[1], **options).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(leaks, digest == leaks[gone], "left_anti")
