"""Connected components of an edge table: bounded contraction inside tasks, then large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

TASK_EDGES = 500_000


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex reachable) of the edges u-v."""
    vertices, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(vertices))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        # Roots take the smallest label next to any of their vertices; then every label jumps to its root.
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return vertices, vertices[label]


def _contract(batches):
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if parts:
        ids, low = labels(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        rest = ids != low
        yield pa.RecordBatch.from_arrays([pa.array(ids[rest], pa.int64()), pa.array(low[rest], pa.int64())], names=["u", "v"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Joins each vertex's larger (or smaller and own) neighbours to its smallest one.

    The smallest neighbour is an aggregate with partial results in every task, and the edges join it again, so the edges
    of a hot vertex stay spread over the tasks that read them.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, component) of every vertex, a long, that an edge touches; component is the smallest id reachable.

    Edges with a null end and loops are ignored; repeated edges and both directions are allowed. Each round deals the
    edges out to tasks of ``task_edges``, which replace theirs by a forest of stars, and joins the forests by a
    large-star and a small-star step; one task's forest is the answer. Every round is written to the shared folder, and
    only a row count and a checksum come back to the driver. Rounds grow with the logarithm of the longest chain.
    """
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    now = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    n, seen = now.count(), None
    while n:
        tasks = -(-n // task_edges)
        now = stored(now.repartition(tasks).mapInArrow(_contract, "u long, v long"), "forest")
        if tasks == 1:
            break
        now = stored(_stars(_stars(now, True), False), "stars")
        at = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        n = at["n"]
        if (n, at["h"]) == seen:
            break
        seen = (n, at["h"])
    # Every vertex but the smallest of its component now has one edge, to that smallest one.
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
