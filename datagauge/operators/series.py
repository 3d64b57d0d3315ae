"""Trend, autocorrelation, volatility and change points of an ordered series.

The order must be total. Neighbour access works on chunks of consecutive rows that overlap by the largest lag, so no
window ever spans the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datagauge.functions.columns import col
from datagauge.functions.tails import student_two_sided
from datagauge.params import AUTOCORRELATION_LAGS

from .ordering import with_row_index, with_running_totals

CHUNK = 1 << 18
MIN_VALUES = 10
MIN_CHANGE_VALUES = 20


def ordered_series(df: DataFrame, value: str, order_by: Sequence[str]) -> DataFrame:
    """``(idx, x)``: the series with its global position, checkpointed."""
    picked = df.select(*order_by, F.col(value).cast("double").alias("x"))
    return with_row_index(picked, order_by).select("idx", "x")


def with_lags(series: DataFrame, lags: Sequence[int], chunk: int = CHUNK) -> DataFrame:
    """Adds ``lag_k`` columns. The last rows of a chunk are sent to the next chunk too, as its left margin."""
    return lag_values(series, lags, chunk, ())


def lag_values(series: DataFrame, lags: Sequence[int], chunk: int, keys: Sequence[str]) -> DataFrame:
    """The same inside every key of a series that has one for each."""
    margin = max(lags)
    chunk = max(chunk, 2 * margin)
    home = F.floor(F.col("idx") / chunk)
    in_margin = (F.col("idx") % chunk) >= chunk - margin
    spread = series.select(
        *[col(k) for k in keys],
        "idx",
        "x",
        home.alias("home"),
        F.explode(F.when(in_margin, F.array(home, home + 1)).otherwise(F.array(home))).alias("chunk"),
    )
    run = Window.partitionBy(*[col(k) for k in keys], "chunk").orderBy("idx")
    lagged = spread.select("*", *[F.lag("x", k).over(run).alias(f"lag_{k}") for k in lags])
    return lagged.where(F.col("chunk") == F.col("home")).drop("chunk", "home")


def linear_trend(series: DataFrame) -> DataFrame:
    """One row: slope on the row position, r², two-sided p-value and direction; a message under 10 values."""
    fit = series.agg(
        F.count("x").alias("n"),
        F.regr_slope("x", "idx").alias("slope"),
        F.regr_r2("x", "idx").alias("r2"),
        F.var_pop("x").alias("variance"),
    ).first()
    schema = "n bigint, slope double, r_squared double, p_value double, direction string, message string"
    spark = series.sparkSession
    if fit.n < MIN_VALUES:
        note = "Insufficient data for time series analysis"
        return spark.createDataFrame([(fit.n, None, None, None, None, note)], schema)
    slope = fit.slope or 0.0
    r2 = 0.0 if not fit.variance else min(1.0, fit.r2)
    t = math.inf if r2 >= 1.0 else math.sqrt(r2 * (fit.n - 2) / (1.0 - r2))
    p_value = student_two_sided(t, fit.n - 2)
    direction = "increasing" if slope > 0 else "decreasing" if slope < 0 else "stable"
    return spark.createDataFrame([(fit.n, round(slope, 6), round(r2, 4), round(p_value, 6), direction, None)], schema)


def autocorrelation(series: DataFrame, lags: Sequence[int] = AUTOCORRELATION_LAGS) -> DataFrame:
    """``(lag, autocorrelation)`` for every lag shorter than the series; 0 where it is undefined."""
    structs = []
    for k in lags:
        known = F.col(f"lag_{k}").isNotNull() & F.col("x").isNotNull()
        x, y = F.when(known, F.col("x")), F.when(known, F.col(f"lag_{k}"))
        value = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        structs.append(
            F.struct(
                F.lit(k).alias("lag"),
                F.coalesce(F.round(value, 4), F.lit(0.0)).alias("autocorrelation"),
                F.count("*").alias("n"),
            )
        )
    rows = with_lags(series, lags).agg(F.array(*structs).alias("lags")).select(F.inline("lags"))
    return rows.where(F.col("n") > F.col("lag")).select("lag", "autocorrelation")


def volatility(series: DataFrame) -> DataFrame:
    """One row: population deviation of the first differences."""
    steps = with_lags(series, [1]).where(F.col("lag_1").isNotNull())
    return steps.agg(F.round(F.stddev_pop(F.col("x") - F.col("lag_1")), 4).alias("volatility"))


def change_points(df: DataFrame, value: str, order_by: Sequence[str]) -> DataFrame:
    """``(idx, left_var, right_var)`` where the variance before and after a position differ by over half the total.

    The window is a tenth of the series, so sums over it come from running totals at three positions, joined on the
    position; the work per row does not grow with the window.
    """
    picked = df.select(*order_by, F.col(value).cast("double").alias("x"))
    stats = picked.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance")).first()
    schema = "idx bigint, left_var double, right_var double"
    if stats.n < MIN_CHANGE_VALUES:
        return df.sparkSession.createDataFrame([], schema)
    width = max(5, stats.n // 10)
    centred = F.col("x") - F.lit(stats.mean)
    totals = {"position": F.lit(1).cast("bigint"), "s1": centred, "s2": centred * centred}
    running = with_running_totals(picked, order_by, totals)
    # Totals before a position: take the row's own term off the inclusive ones.
    before = running.select(
        (F.col("position") - 1).alias("idx"),
        (F.col("s1") - centred).alias("s1"),
        (F.col("s2") - centred * centred).alias("s2"),
    )
    left = before.select((F.col("idx") + width).alias("idx"), F.col("s1").alias("l1"), F.col("s2").alias("l2"))
    right = before.select((F.col("idx") - width).alias("idx"), F.col("s1").alias("r1"), F.col("s2").alias("r2"))

    def spread(s1, s2):
        return s2 / width - (s1 / width) * (s1 / width)

    joined = before.join(left, "idx").join(right, "idx").select(
        "idx",
        spread(F.col("s1") - F.col("l1"), F.col("s2") - F.col("l2")).alias("left_var"),
        spread(F.col("r1") - F.col("s1"), F.col("r2") - F.col("s2")).alias("right_var"),
    )
    return joined.where(F.abs(F.col("left_var") - F.col("right_var")) > F.lit(stats.variance * 0.5))
