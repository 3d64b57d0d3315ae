"""Trend, autocorrelation, volatility and change points of one series for each key.

Positions inside a key come from range partitions of (key, order) with what each partition brings along, so one key may
hold most of the rows. Neighbours are looked up in chunks of a key or joined on (key, position).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datagauge.functions.columns import col
from datagauge.functions.tails import student_two_sided
from datagauge.params import AUTOCORRELATION_LAGS

from .grouped import _joined
from .ordering import with_group_totals
from .series import CHUNK, MIN_CHANGE_VALUES, MIN_VALUES, lag_values


def keyed_series(df: DataFrame, keys: Sequence[str], value: str, order_by: Sequence[str]) -> DataFrame:
    """``(keys, idx, x)``: every key's series with the 0-based position inside the key; the order must be total within
    a key. Null keys are a key, and the columns of the order may not be among the keys."""
    order = [f"order{i}" for i in range(len(order_by))]
    picked = df.select(*[col(k) for k in keys], *[col(c).alias(o) for c, o in zip(order_by, order)], col(value).cast("double").alias("x"))
    placed = with_group_totals(picked, keys, order, {"idx": F.lit(1).cast("bigint")})
    return placed.select(*[col(k) for k in keys], (F.col("idx") - 1).alias("idx"), "x")


@F.pandas_udf(T.DoubleType())
def _two_sided(t: pd.Series, degrees: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else student_two_sided(a, b) for a, b in zip(t, degrees)], dtype="float64")


def trend_by_key(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, n, slope, r_squared, p_value, direction, message)`` as ``series.linear_trend``, a row for each key.

    Sums are folded in the tasks; the tail of the t distribution is taken once for each key.
    """
    fit = series.groupBy(*keys).agg(F.count("x").alias("n"), F.regr_slope("x", "idx").alias("slope"), F.regr_r2("x", "idx").alias("r2"), F.var_pop("x").alias("variance"))
    r2 = F.when(F.col("variance") > 0, F.least(F.lit(1.0), F.col("r2"))).otherwise(0.0)
    slope = F.coalesce("slope", F.lit(0.0))
    enough = F.col("n") >= MIN_VALUES
    t = F.when(r2 >= 1.0, F.lit(float("inf"))).otherwise(F.sqrt(r2 * (F.col("n") - 2) / (1.0 - r2)))
    tested = fit.withColumns({"slope": slope, "r2": r2, "p": _two_sided(F.when(enough, t), (F.col("n") - 2).cast("double"))})
    direction = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable")
    return tested.select(
        *[col(k) for k in keys], "n", *[F.when(enough, v).alias(n) for n, v in (("slope", F.round("slope", 6)), ("r_squared", F.round("r2", 4)), ("p_value", F.round("p", 6)), ("direction", direction))],
        F.when(~enough, "Insufficient data for time series analysis").alias("message"),
    )


def autocorrelation_by_key(series: DataFrame, keys: Sequence[str], lags: Sequence[int] = AUTOCORRELATION_LAGS, chunk: int = CHUNK) -> DataFrame:
    """``(keys, lag, autocorrelation)`` for every lag shorter than the key's series; 0 where it is undefined."""
    rows = lag_values(series, lags, chunk, keys)
    structs = []
    for k in lags:
        known = F.col(f"lag_{k}").isNotNull() & F.col("x").isNotNull()
        x, y = F.when(known, F.col("x")), F.when(known, F.col(f"lag_{k}"))
        value = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        structs.append(F.struct(F.lit(k).alias("lag"), F.coalesce(F.round(value, 4), F.lit(0.0)).alias("autocorrelation"), F.count("*").alias("n")))
    found = rows.groupBy(*keys).agg(F.array(*structs).alias("lags")).select(*[col(k) for k in keys], F.inline("lags"))
    return found.where(F.col("n") > F.col("lag")).drop("n")


def volatility_by_key(series: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """``(keys, volatility)``: population deviation of the first differences; null for a single value."""
    return lag_values(series, [1], chunk, keys).groupBy(*keys).agg(F.round(F.stddev_pop(F.col("x") - F.col("lag_1")), 4).alias("volatility"))


def change_points_by_key(df: DataFrame, keys: Sequence[str], value: str, order_by: Sequence[str]) -> DataFrame:
    """``(keys, idx, left_var, right_var)`` where the variance before and after a position differ by over half the key's.

    The window is a tenth of the key's series, 5 at least; keys of under 20 values have no change points. Sums over a
    window are differences of the key's running totals at its ends, joined on (key, position).
    """
    stats = df.groupBy(*[col(k) for k in keys]).agg(F.count(col(value)).alias("n"), F.avg(col(value).cast("double")).alias("mean"), F.var_pop(col(value).cast("double")).alias("variance"))
    stats = stats.where(F.col("n") >= MIN_CHANGE_VALUES).select(*[col(k) for k in keys], F.struct("n", "mean", "variance").alias("#key"))
    order = [f"order{i}" for i in range(len(order_by))]
    picked = _joined(df.select(*[col(k) for k in keys], *[col(c).alias(o) for c, o in zip(order_by, order)], col(value).cast("double").alias("x")), stats, keys)
    centred = F.col("x") - F.col("#key.mean")
    totals = {"position": F.lit(1).cast("bigint"), "s1": centred, "s2": centred * centred}
    running = with_group_totals(picked, keys, order, totals)
    # Totals before a position: the row's own term is taken off.
    width = F.greatest(F.lit(5), F.floor(F.col("#key.n") / 10))
    before = running.select(*[col(k) for k in keys], (F.col("position") - 1).alias("idx"), (F.col("s1") - centred).alias("s1"), (F.col("s2") - centred * centred).alias("s2"), width.alias("w"), F.col("#key.variance").alias("variance"))

    def at(shift: Column, side: str) -> DataFrame:
        return before.select(*[col(k) for k in keys], (F.col("idx") + shift).alias("idx"), F.col("s1").alias(f"{side}1"), F.col("s2").alias(f"{side}2"))

    def spread(s1: Column, s2: Column) -> Column:
        return s2 / F.col("w") - (s1 / F.col("w")) * (s1 / F.col("w"))

    own = [*keys, "idx"]
    joined = _joined(_joined(before, at(F.col("w"), "l"), own), at(-F.col("w"), "r"), own)
    found = joined.select(
        *own, "variance", spread(F.col("s1") - F.col("l1"), F.col("s2") - F.col("l2")).alias("left_var"), spread(F.col("r1") - F.col("s1"), F.col("r2") - F.col("s2")).alias("right_var")
    )
    return found.where(F.abs(F.col("left_var") - F.col("right_var")) > F.col("variance") * 0.5).drop("variance")
