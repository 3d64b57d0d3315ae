"""Values of a table folded to ``(nth, value, n)``: how often column ``nth`` has each value.

One shuffle for each type family, which exact distinct counts need in any case. What follows (types, patterns, character
classes, lengths, quantiles, outliers) then looks at every different value once, not at every row. Long texts do not
travel: they stay rows of the table with a count of one, and only their digests are counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datagauge.functions.columns import col, families, present, text_form
from datagauge.session import cut_lineage

from .frequency import text_digest
from .ordering import partition_of, ranged

# Longest text that is folded; its bytes weigh about as much as a digest and its row.
SHORT_TEXT = 64


@dataclass(frozen=True)
class Folds:
    """``family`` maps a type family to its folded values; ``rows`` is the table itself, for what is not folded."""

    rows: DataFrame
    family: dict[str, DataFrame]
    kinds: dict[str, str]

    def nth(self, name: str) -> int:
        return self.rows.columns.index(name)

    def long_texts(self) -> DataFrame:
        """``(nth, value, n)`` of the texts of string columns that are not folded, a row each."""
        texts = {n: F.when(F.length(col(n)) > SHORT_TEXT, col(n)) for n, k in self.kinds.items() if k == "string"}
        return _stream(self.rows, texts).withColumn("n", F.lit(1).cast("bigint"))

    def texts(self) -> DataFrame:
        """All texts of string columns."""
        strings = [self.nth(n) for n, k in self.kinds.items() if k == "string"]
        return self.family["text"].where(F.col("nth").isin(strings)).unionByName(self.long_texts())


def _stream(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(df.columns.index(n)).alias("nth"), v.alias("value")) for n, v in values.items()])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull())


def fold_values(df: DataFrame) -> Folds:
    """Folds every column of scalars; each family is stored, as many results are read off it."""
    kinds, groups = families(df), {}
    for name, kind in kinds.items():
        typed = df.schema[name].dataType.typeName()
        if kind == "integer":
            groups.setdefault("long", {})[name] = col(name).cast("bigint")
        elif typed in ("double", "float"):
            groups.setdefault("double", {})[name] = col(name).cast("double")
        elif typed == "timestamp":
            groups.setdefault("long", {})[name] = F.unix_micros(col(name))
        elif typed == "date":
            groups.setdefault("long", {})[name] = F.unix_date(col(name)).cast("bigint")
        elif kind == "string":
            value = present(df, name)
            groups.setdefault("text", {})[name] = F.when(F.length(value) <= SHORT_TEXT, value).cast("string")
        elif kind in ("float", "boolean", "datetime"):
            groups.setdefault("text", {})[name] = text_form(df, name)
    counts = {f: _stream(df, g).groupBy("nth", "value").agg(F.count("*").alias("n")) for f, g in groups.items()}
    return Folds(df, {f: cut_lineage(c) for f, c in counts.items()}, kinds)


def folded_distinct(folds: Folds) -> DataFrame:
    """``(attribute, unique_count)``: exact number of distinct present values."""
    df = folds.rows
    parts = [frame.groupBy("nth").agg(F.count("*").alias("own")) for frame in folds.family.values()]
    whole = {n: F.when(F.length(col(n)) > SHORT_TEXT, text_digest(col(n))) for n, k in folds.kinds.items() if k == "string"}
    whole |= {n: text_digest(text_form(df, n)) for n, k in folds.kinds.items() if k in ("array", "object", "other")}
    if whole:
        parts.append(_stream(df, whole).distinct().groupBy("nth").agg(F.count("*").alias("own")))
    found = reduce(DataFrame.unionByName, parts).groupBy("nth").agg(F.sum("own").alias("unique_count"))
    names = F.array(*[F.lit(n) for n in df.columns])
    return found.select(names[F.col("nth")].alias("attribute"), "unique_count")


def folded_column_quantiles(counts: DataFrame, probabilities: Sequence[float]) -> dict[int, tuple[int, list[float]]]:
    """Per ``nth`` of ``(nth, x, n)`` the number of values and their exact quantiles, by linear interpolation.

    Values are ranged by (nth, x). The sums of each partition tell where a rank lies, and only those partitions are
    numbered. A value may come in several rows.
    """
    placed = ranged(counts, ["nth", "x"]).withColumn("_pid", partition_of("_mid"))
    sums: dict[int, list[tuple[int, int]]] = {}
    # A row for each column and partition.
    for r in placed.groupBy("nth", "_pid").agg(F.sum("n").alias("n")).orderBy("nth", "_pid").collect():
        sums.setdefault(r.nth, []).append((r["_pid"], r.n))
    totals = {nth: sum(n for _, n in own) for nth, own in sums.items()}
    wanted = []
    for nth, own in sums.items():
        ranks = {f(p * (totals[nth] - 1)) for p in probabilities for f in (math.floor, math.ceil)}
        before = 0
        for pid, n in own:
            wanted += [(nth, pid, r, r - before) for r in ranks if before <= r < before + n]
            before += n
    if not wanted:
        return {}
    places = counts.sparkSession.createDataFrame(wanted, "nth int, _pid int, rank bigint, inside bigint")
    held = placed.join(F.broadcast(places.select("nth", "_pid").distinct()), ["nth", "_pid"], "left_semi")
    running = Window.partitionBy("nth", "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    ends = held.withColumn("end", F.sum("n").over(running))
    at = ends.join(F.broadcast(places), ["nth", "_pid"]).where((F.col("inside") >= F.col("end") - F.col("n")) & (F.col("inside") < F.col("end")))
    values = {(r.nth, r["rank"]): r.x for r in at.select("nth", "rank", "x").collect()}
    found = {}
    for nth, total in totals.items():
        quantiles = []
        for p in probabilities:
            place = p * (total - 1)
            low, high = values[nth, math.floor(place)], values[nth, math.ceil(place)]
            quantiles.append(low + (high - low) * (place - math.floor(place)))
        found[nth] = (total, quantiles)
    return found
