"""Outliers by z-score, interquartile range and modified z-score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.functions import columns as C
from datagauge.params import DEFAULTS, Thresholds

from .quantiles import column_quantiles


@dataclass(frozen=True)
class OutlierBounds:
    """What a column's outlier tests compare with; a few numbers per column."""

    count: int
    mean: float | None
    std: float | None
    median: float | None
    mad: float | None
    lower: float | None
    upper: float | None


def outlier_bounds(
    df: DataFrame,
    columns: dict[str, Column],
    limits: Thresholds = DEFAULTS,
    first_pass: dict[str, tuple] | None = None,
) -> dict[str, OutlierBounds]:
    """Two passes for all columns together: moments and quartiles, then the median absolute deviation.

    ``first_pass`` hands in ``(n, mean, std, q1, median, q3)`` per column where a caller has them already.
    """
    if first_pass is None:
        rows = column_quantiles(df, columns, (0.25, 0.5, 0.75), moments=True)
        first_pass = {k: (r.n, r.mean, r.std, *(r.quantiles or (None,) * 3)) for k, r in rows.items()}
    filled = {k: v for k, v in first_pass.items() if v[0]}
    deviations = {k: F.abs(columns[k] - F.lit(v[4])) for k, v in filled.items()}
    second = column_quantiles(df, deviations, (0.5,))
    bounds = {k: OutlierBounds(0, None, None, None, None, None, None) for k in columns}
    for k, (n, mean, std, q1, median, q3) in filled.items():
        spread = limits.iqr_multiplier * (q3 - q1)
        bounds[k] = OutlierBounds(n, mean, std, median, second[k].quantiles[0], q1 - spread, q3 + spread)
    return bounds


def outlier_tests(x: str, b: OutlierBounds, limits: Thresholds = DEFAULTS) -> dict[str, str]:
    """The three tests on a double column as SQL text; false for null, for under 3 values and for a zero spread."""
    num = C.sql_double
    tests = {"z_score": "false", "iqr": "false", "modified_z_score": "false"}
    if b.count < 3:
        return tests
    if b.std:
        tests["z_score"] = f"abs(({x} - {num(b.mean)}) / {num(b.std)}) > {num(limits.z_score)}"
    tests["iqr"] = f"{x} < {num(b.lower)} OR {x} > {num(b.upper)}"
    if b.mad:
        scaled = f"abs({num(limits.modified_z_scale)} * ({x} - {num(b.median)}) / {num(b.mad)})"
        tests["modified_z_score"] = f"{scaled} > {num(limits.modified_z_score)}"
    return {name: f"coalesce({test}, false)" for name, test in tests.items()}


def count_flagged(
    df: DataFrame, columns: dict[str, Column], bounds: dict[str, OutlierBounds], limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Per column: how many values each test flags, how many any test flags, and the interquartile bounds."""
    structs = []
    for k, b in bounds.items():
        t = outlier_tests(C.sql_name(k), b, limits)
        low, high = (f"round({C.sql_double(v)}, 4)" if v is not None else "CAST(NULL AS DOUBLE)" for v in (b.lower, b.upper))
        structs.append(
            f"named_struct('attribute', {C.sql_string(k)}, 'z_score_count', count_if({t['z_score']}), "
            f"'iqr_count', count_if({t['iqr']}), 'modified_z_count', count_if({t['modified_z_score']}), "
            f"'outlier_count', count_if({t['z_score']} OR {t['iqr']} OR {t['modified_z_score']}), "
            f"'lower_bound', {low}, 'upper_bound', {high})"
        )
    values = df.select(*[columns[k].cast("double").alias(k) for k in bounds])
    return values.agg(F.expr(f"array({', '.join(structs)}) AS counts")).selectExpr("inline(counts)")


def outlier_counts(
    df: DataFrame, columns: dict[str, Column], limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Outlier counts per column, with the passes that find the bounds."""
    return count_flagged(df, columns, outlier_bounds(df, columns, limits), limits)


def outlier_rows(
    df: DataFrame, column: str, limits: Thresholds = DEFAULTS
) -> DataFrame:
    """The rows that any test flags, with one boolean per test. The bounds are literals, so the scan can prune."""
    c = F.col(column).cast("double")
    bounds = outlier_bounds(df, {column: c}, limits)[column]
    tests = outlier_tests(f"CAST({C.sql_name(column)} AS DOUBLE)", bounds, limits)
    flagged = df.selectExpr("*", *[f"{test} AS is_{name}" for name, test in tests.items()])
    return flagged.where(F.col("is_z_score") | F.col("is_iqr") | F.col("is_modified_z_score"))
