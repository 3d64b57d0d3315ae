"""Exact quantiles with linear interpolation, by one method at any size.

A sketch of fixed size bounds every wanted rank from below and above, one scan counts the values around each bracket, and
the values inside the brackets are grouped and ranked. A bracket that still holds many values is sketched again inside,
which divides its values by thousands; one that misses its rank is opened and sketched anew. The result is exact, and
the number of scans does not depend on the number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
BRACKET_VALUES = 200_000
# Each scan reads its own columns alone, so small batches cost no more reading from columnar files and run side by side.
COLUMNS_PER_SCAN = 4


def column_quantiles(
    df: DataFrame, columns: dict[str, Column], probabilities: Sequence[float], moments: bool = False
) -> dict[str, Row]:
    """Per key a driver row ``quantiles`` (null where a column has no value), with ``moments`` also ``n``, ``mean``
    and population ``std``."""
    if not columns:
        return {}
    quantiles, stats = _quantiles(df, columns, probabilities, ACCURACY, BRACKET_VALUES)
    kept = ("n", "mean", "std") if moments else ()
    return {k: Row(key=k, quantiles=quantiles[k], **{m: stats[k][m] for m in kept}) for k in columns}


def bracket_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probabilities: Sequence[float],
    accuracy: int = ACCURACY,
    most: int = BRACKET_VALUES,
) -> dict[str, list[float] | None]:
    """The quantiles alone; ``accuracy`` and the values that a bracket may hold do not change them."""
    return _quantiles(df, columns, probabilities, accuracy, most)[0]


def _quantiles(df, columns, probabilities, accuracy, most) -> tuple[dict[str, list[float] | None], dict[str, Row]]:
    # Plain names inside, whatever the keys hold.
    plain = {f"q{i}": k for i, k in enumerate(columns)}
    found, stats = _plain_quantiles(df, {q: columns[k] for q, k in plain.items()}, probabilities, accuracy, most)
    return {k: found[q] for q, k in plain.items()}, {k: stats[q] for q, k in plain.items()}


def _plain_quantiles(df, columns, probabilities, accuracy, most):
    typed = df.select(*[c.cast("double").alias(k) for k, c in columns.items()])
    brackets, stats = _first_brackets(typed, list(columns), probabilities, accuracy)
    ranks = {k: [_ranks(p, stats[k].n) for p in probabilities] for k in brackets}
    below = _counts_around(typed, brackets)
    for attempt in range(64):
        again = {}
        for k, own in brackets.items():
            for i, (low, high) in enumerate(own):
                under, upto = below[k].below[i], below[k].upto[i]
                first, last = ranks[k][i]
                if under > first or upto <= last:
                    again[k, i] = (-math.inf if under > first else low, math.inf if upto <= last else high)
                elif upto - under > most and low < high:
                    again[k, i] = (low, high)
        if not again:
            break
        brackets, narrowed = _narrowed(typed, brackets, below, ranks, again, accuracy, stats)
        if not narrowed:
            break
        below = _counts_around(typed, brackets)

    picked = _values_at(typed, brackets, ranks, below)
    result: dict[str, list[float] | None] = dict.fromkeys(columns)
    for k in brackets:
        values = []
        for i, p in enumerate(probabilities):
            low, high = picked[k, i]
            position = p * (stats[k].n - 1)
            values.append(low + (high - low) * (position - math.floor(position)))
        result[k] = values
    return result, stats


def _col(key: str) -> Column:
    return F.col(f"`{key}`")


def _ranks(p: float, n: int) -> tuple[int, int]:
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def _batched(keys: Sequence) -> list[list]:
    return [list(keys[at : at + COLUMNS_PER_SCAN]) for at in range(0, len(keys), COLUMNS_PER_SCAN)]


def _one_row_per_key(typed: DataFrame, keys: Sequence[str], build) -> dict[str, Row]:
    """Aggregates the keys, many in a scan."""
    parts = []
    for batch in _batched(keys):
        structs = [F.struct(F.lit(k).alias("key"), *build(k)).alias(k) for k in batch]
        parts.append(typed.agg(*structs).select(F.inline(F.array(*[_col(k) for k in batch]))))
    return {row.key: row for row in reduce(DataFrame.unionByName, parts).collect()}


def _edges(probabilities: Sequence[float], accuracy: int) -> list[float]:
    slack = 2.0 / accuracy
    return [max(0.0, p - slack) for p in probabilities] + [min(1.0, p + slack) for p in probabilities]


def _first_brackets(typed, keys, probabilities, accuracy) -> tuple[dict[str, list[tuple[float, float]]], dict[str, Row]]:
    """Brackets of the keys that have values; the number, mean and spread of the values of every key."""
    edges = _edges(probabilities, accuracy)
    rows = _one_row_per_key(
        typed,
        keys,
        lambda k: [
            F.percentile_approx(_col(k), edges, accuracy).alias("edges"), F.count(_col(k)).alias("n"),
            F.avg(_col(k)).alias("mean"), F.stddev_pop(_col(k)).alias("std"),
        ],
    )
    half = len(probabilities)
    found = {k: [(rows[k].edges[i], rows[k].edges[half + i]) for i in range(half)] for k in keys if rows[k].n}
    return found, rows


def _narrowed(typed, brackets, below, ranks, again, accuracy, stats):
    """Sketches the values inside some brackets; returns all brackets, and whether any of them changed."""
    wanted: dict[str, list[int]] = {}
    for k, i in again:
        wanted.setdefault(k, []).append(i)
    slots = [(k, i) for k in wanted for i in wanted[k]]

    def build(k: str) -> list[Column]:
        sketches = []
        for i in wanted[k]:
            low, high = again[k, i]
            under = below[k].below[i] if low == brackets[k][i][0] else 0
            upto = below[k].upto[i] if high == brackets[k][i][1] else stats[k].n
            inside = max(1, upto - under)
            first, last = ranks[k][i]
            slack = 2.0 / accuracy
            edges = [max(0.0, (first - under) / inside - slack), min(1.0, (last + 1 - under) / inside + slack)]
            value = F.when(_col(k).between(F.lit(low), F.lit(high)), _col(k))
            sketches.append(F.percentile_approx(value, edges, accuracy))
        return [F.array(*sketches).alias("edges")]

    rows = _one_row_per_key(typed, list(wanted), build)
    out = {k: list(v) for k, v in brackets.items()}
    for k, i in slots:
        out[k][i] = tuple(rows[k].edges[wanted[k].index(i)])
    return out, any(out[k][i] != brackets[k][i] for k, i in slots)


def _counts_around(typed: DataFrame, brackets: dict[str, list[tuple[float, float]]]) -> dict[str, Row]:
    """Per key and bracket: how many values lie under it, and how many up to its upper edge."""
    if not brackets:
        return {}

    def build(k: str) -> list[Column]:
        return [
            F.array(*[F.count_if(_col(k) < F.lit(low)) for low, _ in brackets[k]]).alias("below"),
            F.array(*[F.count_if(_col(k) <= F.lit(high)) for _, high in brackets[k]]).alias("upto"),
        ]

    return _one_row_per_key(typed, list(brackets), build)


def _values_at(typed, brackets, ranks, below) -> dict[tuple[str, int], tuple[float, float]]:
    """The values at both ranks of every bracket. Only values inside a bracket are shuffled, grouped by value.

    A bracket of one value needs no scan; the others hold a bounded number of values.
    """
    slots = [(k, i) for k in brackets for i in range(len(brackets[k]))]
    found = {(k, i): brackets[k][i] for k, i in slots if brackets[k][i][0] == brackets[k][i][1]}
    slots = [s for s in slots if s not in found]
    if not slots:
        return found
    parts = []
    for batch in _batched(list(dict.fromkeys(k for k, _ in slots))):
        inside = [
            F.when(
                _col(k).between(F.lit(brackets[k][i][0]), F.lit(brackets[k][i][1])),
                F.struct(F.lit(n).alias("slot"), _col(k).alias("value")),
            )
            for n, (k, i) in enumerate(slots)
            if k in batch
        ]
        parts.append(typed.select(*[_col(k) for k in batch]).select(F.inline(F.array_compact(F.array(*inside)))))
    grouped = reduce(DataFrame.unionByName, parts).groupBy("slot", "value").agg(F.count("*").alias("n"))
    running = Window.partitionBy("slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ends = grouped.withColumn("end", F.sum("n").over(running))
    wanted = F.create_map(
        *[
            x
            for n, (k, i) in enumerate(slots)
            for x in (F.lit(n), F.array(*[F.lit(rank - below[k].below[i]) for rank in ranks[k][i]]))
        ]
    )
    at = ends.select("slot", "value", "end", (F.col("end") - F.col("n")).alias("start"), wanted[F.col("slot")].alias("w"))

    def holds(side: int) -> Column:
        return (F.col("start") <= F.col("w")[side]) & (F.col("w")[side] < F.col("end"))

    rows = (
        at.where(holds(0) | holds(1))
        .groupBy("slot")
        .agg(
            F.max(F.when(holds(0), F.col("value"))).alias("low"),
            F.max(F.when(holds(1), F.col("value"))).alias("high"),
        )
        .collect()
    )
    return found | {slots[r.slot]: (r.low, r.high) for r in rows}
