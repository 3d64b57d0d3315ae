"""Distinct counts, value counts and top values for many columns at once.

Columns are unpivoted to ``(attribute, value)`` and grouped, so one shuffle serves every column of a type family and
a hot value is folded into one row per task before it is sent. Strings are counted by their SHA-256 digest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datagauge.functions.columns import col, families, present, text_form


def text_digest(value: Column) -> Column:
    return F.unhex(F.sha2(value.cast("binary"), 256))


def _unpivot(df: DataFrame, values: dict[str, Column], *carried: Column) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("attribute"), v.alias("value")) for n, v in values.items()])
    return df.select(*carried, F.inline(pairs)).where(F.col("value").isNotNull())


def _by_family(df: DataFrame, columns: Sequence[str]) -> list[dict[str, Column]]:
    kinds = families(df)
    groups: dict[str, dict[str, Column]] = {"long": {}, "double": {}, "text": {}}
    for name in columns:
        if kinds[name] == "integer":
            groups["long"][name] = col(name).cast("bigint")
        elif kinds[name] == "float" and df.schema[name].dataType.typeName() in ("double", "float"):
            groups["double"][name] = col(name).cast("double")
        elif df.schema[name].dataType.typeName() == "timestamp":
            groups["long"][name] = F.unix_micros(col(name))
        elif df.schema[name].dataType.typeName() == "date":
            groups["long"][name] = F.unix_date(col(name)).cast("bigint")
        else:
            value = present(df, name) if kinds[name] == "string" else text_form(df, name)
            groups["text"][name] = text_digest(value)
    return [g for g in groups.values() if g]


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """``(attribute, unique_count)``: exact number of distinct present values, or a sketch estimate on request."""
    columns = list(columns or df.columns)
    if approximate:
        estimates = [F.approx_count_distinct(v).alias(n) for g in _by_family(df, columns) for n, v in g.items()]
        pairs = [
            F.struct(F.lit(n).alias("attribute"), col(n).alias("unique_count"))
            for g in _by_family(df, columns)
            for n in g
        ]
        return df.agg(*estimates).select(F.inline(F.array(*pairs)))
    parts = [
        _unpivot(df, group).distinct().groupBy("attribute").agg(F.count("*").alias("unique_count"))
        for group in _by_family(df, columns)
    ]
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, columns: Sequence[str], order_by: str | None = None) -> DataFrame:
    """``(attribute, value, n[, first_at])`` in string form; ``first_at`` is the smallest order value that has it."""
    kinds = families(df)
    values = {n: present(df, n) if kinds[n] == "string" else text_form(df, n) for n in columns}
    carried = [col(order_by).alias("_ord")] if order_by else []
    counts = [F.count("*").alias("n")] + ([F.min("_ord").alias("first_at")] if order_by else [])
    return _unpivot(df, values, *carried).groupBy("attribute", "value").agg(*counts)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5, order_by: str | None = None) -> DataFrame:
    """The ``k`` most common values per column, ties by first appearance, or by value without ``order_by``.

    The filter on ``row_number`` keeps ``k`` rows per column in every task before the last shuffle.
    """
    counts = value_counts(df, columns, order_by)
    tie = ["first_at", "value"] if order_by else ["value"]
    ranked = Window.partitionBy("attribute").orderBy(F.col("n").desc(), *tie)
    return (
        counts.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("attribute", "rank", "value", "n")
    )
