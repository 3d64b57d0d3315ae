"""Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors, about twice the square root of their number. A vector is described
by its nearest pivots in order, and stands in the inverted list of each. In a list, pairs are counted by the pivots that
they share; those with enough of them are candidates, looked at in the list of the smallest pivot that they share, and
verified by their cosine in double precision. Every verified link is kept.

Equal vectors of a label are one entry with a number of copies. A long list is cut into blocks, and every pair of blocks
is a group of its own, so no task holds more than two blocks. A group returns a row for each vector with links: how
many, and the smallest vector of its part of the group. Pairs themselves are never written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, labels
from .shared import quoted, stored

NEAREST = 8
SHARED = 1
BLOCK = 1024
MOST_PIVOTS = 1 << 14


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def _units(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _pivots(classes: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Unit vectors of the pivots by dimension, at most ``most`` each: the first vectors in the order of a hash."""
    out = {}
    for row in classes.groupBy("dim").count().collect():
        wanted = min(most, max(16, round(2 * row["count"] ** 0.5)))
        drawn = classes.where(F.col("dim") == row["dim"]).orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("embedding").collect()
        out[row["dim"]] = _units(np.array([r["embedding"] for r in drawn], dtype=np.float64))
    return out


def _described(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """Adds the numbers of the nearest pivots, nearest first; ties go to the smaller number."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def describe(batches):
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                points = shared.value[int(dim)]
                k = min(nearest, len(points))
                for a in range(0, part.num_rows, 4096):
                    rows = part.slice(a, 4096)
                    order = np.argsort(-(_units(_matrix(rows.column(4), int(dim))) @ points.T), axis=1, kind="stable")[:, :k].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(order) * k + 1, k, dtype=np.int32)), pa.array(order.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=["label", "dim", "rep", "copies", "embedding", "near"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    return classes.mapInArrow(describe, ", ".join(f"{c} {kinds[c]}" for c in ("label", "dim", "rep", "copies", "embedding")) + ", near array<int>")


def _candidates(left: np.ndarray, right: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Which pairs of rows of two tables of pivots share at least ``shared`` of them, ``pivot`` being the smallest."""
    count, smaller = np.zeros((len(left), len(right)), dtype=np.uint8), np.zeros((len(left), len(right)), dtype=bool)
    for i in range(left.shape[1]):
        for j in range(right.shape[1]):
            same = left[:, i, None] == right[None, :, j]
            smaller |= same & (left[:, i, None] < pivot)
            if shared > 1:
                count += same
    return ~smaller if shared <= 1 else ~smaller & (count >= shared)


def _linker(threshold: float, shared: int):
    """The links of one group: block ``i`` against block ``j`` of one list."""

    def link(key, table):
        dim, pivot, i, j = (key[n].as_py() for n in (1, 2, 3, 4))
        table = table.combine_chunks()
        block = np.asarray(table.column("block"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = {"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "low": np.zeros(0, np.int64)}
        if len(left) and len(right):
            ids, copies = np.asarray(table.column("rep")), np.asarray(table.column("copies"))
            units = _units(_matrix(table.column("embedding").chunk(0), dim))
            near = np.asarray(table.column("near").chunk(0).flatten()).reshape(table.num_rows, -1)
            # Shared pivots of every pair, and the smallest of them; then cosines of the candidates alone count.
            candidate = _candidates(near[left], near[right], pivot, min(shared, near.shape[1]))
            candidate &= ids[left][:, None] < ids[right][None, :] if i == j else ids[left][:, None] != ids[right][None, :]
            a, b = np.nonzero(candidate & (units[left] @ units[right].T >= threshold))
            a, b = left[a], right[b]
            if len(a):
                number = np.zeros(table.num_rows, dtype=np.int64)
                np.add.at(number, a, copies[b])
                np.add.at(number, b, copies[a])
                vertices, low = labels(ids[a], ids[b])
                some = np.flatnonzero(number)
                some = some[np.argsort(ids[some])]
                out = {"rep": ids[some], "links": number[some], "low": low[np.searchsorted(vertices, ids[some])]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return link


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    threshold: float = 0.98,
    nearest: int = NEAREST,
    shared: int = SHARED,
    block: int = BLOCK,
    most_pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Two vectors of one label and length link when their cosine is at least ``threshold``; n_links counts the other rows
    linked directly, as far as the index finds them, component_id is the smallest id reachable, kept says whether it is
    the vector's own. Equal vectors always link. Vectors that are null or zero, or hold null or non-finite numbers, and
    those of null label link with nothing and are kept. A null id has no links, a null component and is kept; rows that
    repeat an id share its component and links. An empty table gives an empty one. Without a label
    column all vectors are compared.
    """
    label = F.lit(0) if label_col is None else F.col(quoted(label_col))
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), label.alias("label"), F.col(quoted(vector_col)).cast("array<double>").alias("embedding"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    rows = stored(rows, "vectors")
    good = rows.where("usable").withColumn("dim", F.size("embedding"))
    classes = stored(good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("label", "dim", "rep", "copies", "embedding"), "vector-classes")

    described = stored(_described(classes, _pivots(classes, most_pivots), nearest), "vectors-described")
    posted = described.withColumn("pivot", F.explode("near"))
    long_lists = posted.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    long_lists = stored(long_lists, "vector-lists")
    posted = posted.join(long_lists, ["label", "dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("rep", "embedding"), F.col("blocks")).cast("int"))
    # A block meets itself and every other once: (i, j) with i <= j.
    posted = posted.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posted = posted.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with", "blocks")
    found = posted.groupBy("label", "dim", "pivot", "i", "j").applyInArrow(_linker(threshold, shared), "rep long, links long, low long")
    found = stored(found, "vector-links")

    number = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v")))
    classes = classes.join(number, "rep", "left").join(component.withColumnRenamed("id", "rep"), "rep", "left")
    plan = classes.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    plan = stored(plan, "vector-plan")
    done = good.select("vec_id", "label", "embedding").join(plan, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return done.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
