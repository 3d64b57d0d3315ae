"""Distribution statistics, percentiles, distribution type and correlation of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.functions import columns as C
from datagauge.functions.tails import kolmogorov_two_sided, normal_quantile_sql, shapiro_of_sums
from datagauge.params import DEFAULT_PERCENTILES, DEFAULTS, Thresholds

from .ordering import with_row_index, with_running_totals
from .outliers import outlier_counts
from .quantiles import column_quantiles

SHAPIRO_ROWS = 5000
MIN_VALUES = 10
# Columns whose pairs share a scan.
PAIRED_COLUMNS = 8


def _unpivot(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    pairs = [F.struct(F.lit(k).alias("attribute"), c.cast("double").alias("x")) for k, c in columns.items()]
    return df.select(F.inline(F.array(*pairs))).where(F.col("x").isNotNull())


def modes(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(attribute, mode)``: the most common value, the smallest one on a tie."""
    counts = _unpivot(df, columns).groupBy("attribute", "x").agg(F.count("*").alias("n"))
    best = counts.groupBy("attribute").agg(F.max(F.struct("n", (-F.col("x")).alias("negated"))).alias("best"))
    return best.select("attribute", (-F.col("best.negated")).alias("mode"))


def distribution_stats(df: DataFrame, columns: dict[str, Column], digits: int = 4) -> DataFrame:
    """Mean, median, mode, population spread, skewness, excess kurtosis, range and variation per column."""
    medians = column_quantiles(df, columns, (0.5,))
    structs = []
    for k, c in columns.items():
        x = c.cast("double")
        mean, std = F.avg(x), F.stddev_pop(x)
        median = medians[k].quantiles[0] if medians[k].quantiles else None
        values = {
            "mean": mean,
            "median": F.lit(median).cast("double"),
            "std": std,
            "variance": F.var_pop(x),
            "skewness": F.skewness(x),
            "kurtosis": F.kurtosis(x),
            "range": F.max(x) - F.min(x),
            "coefficient_of_variation": F.when(mean == 0, 0.0).otherwise(C.ratio(std, mean)),
        }
        structs.append(
            F.struct(F.lit(k).alias("attribute"), *[F.round(v, digits).alias(n) for n, v in values.items()]).alias(k)
        )
    stats = df.agg(*structs).select(F.inline(F.array(*[F.col(f"`{k}`") for k in columns])))
    top = modes(df, columns).select("attribute", F.round("mode", digits).alias("mode"))
    # One row per column on both sides.
    return stats.join(F.broadcast(top), "attribute", "left")


def percentile_table(
    df: DataFrame,
    columns: dict[str, Column],
    percentiles: Sequence[float] = DEFAULT_PERCENTILES,
    digits: int = 4,
) -> DataFrame:
    """``(attribute, percentile, value)`` with percentiles named like ``25th``."""
    rows = column_quantiles(df, columns, [p / 100 for p in percentiles])
    flat = [
        (k, f"{p:g}th", r.quantiles[i])
        for k, r in rows.items()
        if r.quantiles
        for i, p in enumerate(percentiles)
    ]
    frame = df.sparkSession.createDataFrame(flat, "attribute string, percentile string, value double")
    return frame.withColumn("value", F.round("value", digits))


def string_length_analysis(df: DataFrame, column: str) -> DataFrame:
    """One row: statistics, percentiles and outlier counts of string lengths; empty and one-character counts."""
    length = {column: F.length(F.col(column))}
    stats = distribution_stats(df, length)
    quantiles = column_quantiles(df, {column: length[column].cast("double")}, [p / 100 for p in DEFAULT_PERCENTILES])
    found = quantiles[column].quantiles or [None] * len(DEFAULT_PERCENTILES)
    outliers = outlier_counts(df, {column: length[column].cast("double")})
    shorts = df.agg(
        F.lit(column).alias("attribute"),
        F.count_if(length[column] == 0).alias("empty_strings"),
        F.count_if(length[column] == 1).alias("single_char_strings"),
    )
    joined = stats.join(F.broadcast(outliers), "attribute").join(F.broadcast(shorts), "attribute")
    named = [F.round(F.lit(v).cast("double"), 4).alias(f"p{p}") for p, v in zip(DEFAULT_PERCENTILES, found)]
    return joined.select("*", *named)


def correlation_pairs(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``(attribute1, attribute2, correlation)`` of every pair of numeric columns, each pair over its complete rows.

    Pairs are aggregated in the tasks, some hundred in a scan, so the shuffle holds one row per task however long the
    table is. Null where a column is constant.
    """
    names = list(names or C.numeric_columns(df))
    if len(names) < 2:
        raise ValueError("at least two numeric columns are needed")
    # Plain names inside, and columns in batches, so that the pairs of two batches make one scan.
    doubles = df.select(*[C.col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    batches = [range(a, min(a + PAIRED_COLUMNS, len(names))) for a in range(0, len(names), PAIRED_COLUMNS)]
    parts = []
    for b, right in enumerate(batches):
        for left in batches[: b + 1]:
            pairs = [(i, j) for i in left for j in right if i < j]
            if not pairs:
                continue
            found = doubles.agg(*[_correlation(f"c{i}", f"c{j}").alias(f"r{i}_{j}") for i, j in pairs])
            rows = [F.struct(F.lit(names[i]).alias("attribute1"), F.lit(names[j]).alias("attribute2"), F.col(f"r{i}_{j}").alias("correlation")) for i, j in pairs]
            parts.append(found.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def _correlation(x: str, y: str) -> Column:
    """Over the rows that have both; null where either is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def high_correlations(pairs: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Pairs whose correlation exceeds the limit, marked strong or moderate."""
    size = F.abs("correlation")
    return pairs.where(size > limits.high_correlation).withColumn(
        "strength", F.when(size > limits.strong_correlation, "strong").otherwise("moderate")
    )


def _normality(n: int, skew: float, excess: float) -> float:
    """p-value of the omnibus normality test of D'Agostino and Pearson; the chi-square tail has a closed form."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta2 - 1)) - 1
    z_skew = math.asinh((y if y else 1.0) / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    centre = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3.0) * (n + 5))
    x = (excess + 3.0 - centre) / math.sqrt(variance)
    root_beta = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root_beta * (2 / root_beta + math.sqrt(1 + 4 / root_beta**2))
    denominator = 1 + x * math.sqrt(2 / (a - 4))
    if denominator == 0:
        return 0.0
    cube = math.copysign(abs((1 - 2 / a) / abs(denominator)) ** (1 / 3), denominator)
    z_kurtosis = (1 - 2 / (9 * a) - cube) / math.sqrt(2 / (9 * a))
    return math.exp(-(z_skew**2 + z_kurtosis**2) / 2)


def kolmogorov_distances(df: DataFrame, column: str) -> DataFrame:
    """One row: n and the largest distance of the empirical distribution to Expon(0, 1) and to U(0, 1).

    Equal values are folded first, so the global order runs over distinct values and a hot value is one row.
    """
    x = F.col(column).cast("double")
    counts = df.select(x.alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    ranked = with_running_totals(counts, ["x"], {"upto": F.col("n")})
    total = ranked.agg(F.sum("n")).first()[0] or 0
    if total == 0:
        schema = "n bigint, d_exponential double, d_uniform double"
        return df.sparkSession.createDataFrame([(0, None, None)], schema)
    value = F.col("x")
    cdf = {
        "d_exponential": F.when(value > 0, 1 - F.exp(-value)).otherwise(0.0),
        "d_uniform": F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)),
    }
    upper, lower = F.col("upto") / F.lit(float(total)), (F.col("upto") - F.col("n")) / F.lit(float(total))
    distances = [F.max(F.greatest(upper - f, f - lower)).alias(name) for name, f in cdf.items()]
    return ranked.agg(F.sum("n").alias("n"), *distances)


def shapiro_sums(df: DataFrame, column: str) -> DataFrame:
    """One row: ``(n, norm2, scored, spread, ends)``, the sums over global ranks that the Shapiro-Wilk test is made of.

    Ranks come from a global order in which equal values may be cut anywhere; scores and sums are expressions.
    """
    x = F.col(column).cast("double")
    values = df.select(x.alias("x"), F.monotonically_increasing_id().alias("nth")).where("x is not null")
    stats = values.agg(F.count("x").alias("n"), F.avg("x").alias("mean")).first()
    ranked = with_row_index(values, ["x", "nth"], "idx").select((F.col("x") - F.lit(stats.mean)).alias("d"), "idx", F.expr(f"(idx + 0.625D) / ({stats.n} + 0.25D)").alias("p"))
    scored = ranked.select("d", "idx", F.expr(normal_quantile_sql("p")).alias("m"))
    ends = [F.max(F.when(F.col("idx") == i, F.col("d"))) for i in (0, 1, stats.n - 2, stats.n - 1)]
    return scored.agg(
        F.count("*").alias("n"), F.sum(F.col("m") * F.col("m")).alias("norm2"), F.sum(F.col("m") * F.col("d")).alias("scored"),
        F.sum(F.col("d") * F.col("d")).alias("spread"), F.array(*ends).alias("ends"),
    )


def distribution_type(df: DataFrame, column: str) -> DataFrame:
    """One row: p-values of normality and of the two reference distributions, the best one, and Shapiro-Wilk.

    The Shapiro test is approximated for 3 to 5000 values; its columns are null for larger inputs, ``is_normal`` too.
    """
    x = F.col(column).cast("double")
    moments = df.agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess")).first()
    schema = (
        "n bigint, likely_distribution string, confidence double, p_normal double, p_exponential double, "
        "p_uniform double, shapiro_statistic double, shapiro_p double, is_normal boolean"
    )
    if moments.n < MIN_VALUES:
        row = (moments.n, "insufficient_data", 0.0, None, None, None, None, None, None)
        return df.sparkSession.createDataFrame([row], schema)
    d = kolmogorov_distances(df, column).first()
    p = {
        "normal": 0.0 if moments.skew is None else _normality(moments.n, moments.skew, moments.excess),
        "exponential": kolmogorov_two_sided(d.d_exponential, moments.n),
        "uniform": kolmogorov_two_sided(d.d_uniform, moments.n),
    }
    statistic = shapiro_p = None
    if moments.n <= SHAPIRO_ROWS:
        sums = shapiro_sums(df, column).first()
        statistic, shapiro_p = shapiro_of_sums(sums.n, sums.norm2, sums.scored, sums.spread, tuple(sums.ends))
    best = max(p, key=p.get)
    row = (
        moments.n, best, round(p[best], 4), round(p["normal"], 4), round(p["exponential"], 4),
        round(p["uniform"], 4),
        *((None, None, None) if shapiro_p is None else (round(statistic, 4), round(shapiro_p, 4), shapiro_p > 0.05)),
    )
    return df.sparkSession.createDataFrame([row], schema)
