"""Global row order without a single-partition window.

Rows are range-partitioned and sorted by a total order, numbered inside their partition, and the frame is
checkpointed so that the numbering survives lost executors. Only one count (or sum) per partition is collected; the
running offsets come back as a broadcast frame with one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datagauge.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above these bits and the row position below


def partition_of(mid: str) -> Column:
    """The partition of a row that ``ranged`` placed."""
    return F.shiftright(mid, _LOCAL_BITS).cast("int")


def ranged(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The rows in stored partitions of ascending order; ``_mid`` numbers them."""
    ordered = df.repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
    return cut_lineage(ordered.withColumn("_mid", F.monotonically_increasing_id()))


def _with_offsets(rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Adds ``_pid`` and per total the sum over all earlier partitions, as ``name#before``."""
    placed = rows.withColumn("_pid", partition_of("_mid"))
    sums = placed.groupBy("_pid").agg(*[F.sum(v).alias(n) for n, v in totals.items()]).orderBy("_pid")
    before, offsets = {n: 0 for n in totals}, []
    for row in sums.collect():
        offsets.append((row["_pid"], *before.values()))
        before = {n: v + (row[n] or 0) for n, v in before.items()}
    kinds = {n: "bigint" if sums.schema[n].dataType.typeName() == "long" else "double" for n in totals}
    schema = "_pid int, " + ", ".join(f"`{n}#before` {k}" for n, k in kinds.items())
    typed = [(r[0], *[v if k == "bigint" else float(v) for v, k in zip(r[1:], kinds.values())]) for r in offsets]
    return placed.join(F.broadcast(placed.sparkSession.createDataFrame(typed, schema)), "_pid")


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "idx") -> DataFrame:
    """Adds the 0-based position of every row under ``order_by``, which must be a total order."""
    local = F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)
    placed = _with_offsets(ranged(df, order_by), {name: F.lit(1).cast("bigint")})
    return placed.withColumn(name, F.col(f"`{name}#before`") + local).drop("_mid", "_pid", f"{name}#before")


def with_running_totals(df: DataFrame, order_by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Adds inclusive running totals over the whole order, one column per entry of ``totals``."""
    rows = ranged(df.withColumns(totals), order_by)
    placed = _with_offsets(rows, {n: F.col(n) for n in totals})
    within = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    running = {n: F.sum(n).over(within) + F.col(f"`{n}#before`") for n in totals}
    return placed.withColumns(running).drop("_mid", "_pid", *[f"{n}#before" for n in totals])


def with_group_totals(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Adds inclusive running totals inside every key, under an order that is total within a key.

    Rows are range-partitioned by key and order, so a hot key lies in as many tasks as its rows fill. Of the keys of a
    partition only the first can begin in an earlier one; what it brings along is one row for each partition.
    """
    rows = ranged(df.withColumns(totals), [*keys, *order_by])
    placed = rows.withColumn("_pid", partition_of("_mid"))
    per_key = placed.groupBy("_pid", *keys).agg(F.min("_mid").alias("_mid"), *[F.sum(n).alias(n) for n in totals])
    key = F.struct(*keys)
    ends = per_key.groupBy("_pid").agg(
        F.min_by(key, "_mid").alias("first"), F.max_by(key, "_mid").alias("last"), F.count("*").alias("keys"), F.max_by(F.struct(*totals), "_mid").alias("sums")
    )
    carried, key_before, sums_before = [], None, None
    for row in sorted(ends.collect(), key=lambda r: r["_pid"]):
        goes_on = key_before is not None and all(a == b or (a != a and b != b) for a, b in zip(row["first"], key_before))
        brought = sums_before if goes_on else tuple(0 for _ in totals)
        carried.append((row["_pid"], *brought))
        own = tuple(v or 0 for v in row["sums"])
        key_before, sums_before = row["last"], tuple(a + b for a, b in zip(own, brought)) if row["keys"] == 1 else own
    kinds = ["bigint" if per_key.schema[n].dataType.typeName() == "long" else "double" for n in totals]
    schema = "_pid int, " + ", ".join(f"`{n}#before` {k}" for n, k in zip(totals, kinds))
    typed = [(r[0], *[v if k == "bigint" else float(v) for v, k in zip(r[1:], kinds)]) for r in carried]
    placed = placed.join(F.broadcast(placed.sparkSession.createDataFrame(typed, schema)), "_pid")
    within = Window.partitionBy("_pid", *keys).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    in_first = F.first("_mid").over(within).bitwiseAND((1 << _LOCAL_BITS) - 1) == 0
    running = {n: F.sum(n).over(within) + F.when(in_first, F.col(f"`{n}#before`")).otherwise(F.lit(0)) for n in totals}
    return placed.withColumns(running).drop("_mid", "_pid", *[f"{n}#before" for n in totals])
