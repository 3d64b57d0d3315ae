import math

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from datagauge.functions import tails
from datagauge.operators import distribution, outliers, series
from datagauge.operators.ordering import with_row_index, with_running_totals
from datagauge.operators.quantiles import bracket_quantiles, column_quantiles

from .conftest import by


def numbers(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, x double")


def x_column():
    return {"x": F.col("x")}


def test_outlier_in_a_short_list(spark):
    found = outliers.outlier_rows(numbers(spark, [1, 2, 3, 100, 5, 6, 7]), "x").collect()
    assert [r.i for r in found] == [3]


@pytest.mark.parametrize("values", [[], [5, 5], [1, 100], [3] * 20])
def test_no_outliers(spark, values):
    row = outliers.outlier_counts(numbers(spark, values), x_column()).first()
    assert (row.z_score_count, row.iqr_count, row.modified_z_count, row.outlier_count) == (0, 0, 0, 0)


def test_zero_mad_leaves_the_other_tests(spark):
    row = outliers.outlier_counts(numbers(spark, [1] * 30 + [50]), x_column()).first()
    assert (row.z_score_count, row.iqr_count, row.modified_z_count, row.outlier_count) == (1, 1, 0, 1)


def test_combined_outliers_cover_each_test(spark):
    rng = np.random.default_rng(5)
    row = outliers.outlier_counts(numbers(spark, rng.standard_t(2, 3000)), x_column()).first()
    assert row.outlier_count >= max(row.z_score_count, row.iqr_count, row.modified_z_count) > 0


@pytest.mark.parametrize("accuracy, most", [(50, 200_000), (50, 10), (10_000, 200_000), (10_000, 1)])
def test_bracket_quantiles_equal_numpy(spark, accuracy, most):
    rng = np.random.default_rng(3)
    # A third of the values is one value; the rest is heavy-tailed; some are null.
    values = np.concatenate([np.full(4000, 7.25), rng.lognormal(1, 2, 8000)])
    rng.shuffle(values)
    rows = [*values.tolist(), None, None]
    wanted = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = numbers(spark, rows).repartition(5)
    found = bracket_quantiles(df, x_column(), wanted, accuracy, most)["x"]
    assert found == pytest.approx([np.quantile(values, p) for p in wanted])
    assert column_quantiles(df, x_column(), wanted)["x"].quantiles == pytest.approx(found)


def test_bracket_quantiles_of_nothing_and_one(spark):
    df = numbers(spark, [None, None])
    assert bracket_quantiles(df, x_column(), [0.5]) == {"x": None}
    assert bracket_quantiles(numbers(spark, [4]), x_column(), [0.1, 0.9]) == {"x": [4.0, 4.0]}


def test_quantiles_of_many_columns(spark):
    df = spark.range(1000).select(*[(F.col("id") * n).cast("double").alias(f"c{n}") for n in range(1, 12)])
    columns = {c: F.col(c) for c in df.columns}
    found = bracket_quantiles(df, columns, [0.5], 20)
    assert all(found[f"c{n}"] == [499.5 * n] for n in range(1, 12))


def test_distribution_stats(spark):
    row = distribution.distribution_stats(numbers(spark, [1, 2, 3, 4, 5]), x_column()).first()
    assert (row.mean, row.median, row.mode, row["range"]) == (3.0, 3.0, 1.0, 4.0)
    assert row.std == round(math.sqrt(2), 4) and row.variance == 2.0
    assert row.skewness == 0.0 and row.kurtosis == -1.3
    assert row.coefficient_of_variation == round(math.sqrt(2) / 3, 4)


def test_mode_takes_the_smallest_on_a_tie(spark):
    assert distribution.modes(numbers(spark, [9, 9, -2, -2, 5]), x_column()).first().mode == -2.0


def test_median_percentile_of_a_range(spark):
    rows = by(distribution.percentile_table(numbers(spark, range(1, 101)), x_column()), "percentile")
    assert rows["50th"]["value"] == 50.5 and set(rows) >= {"1th", "99th"}


def test_string_lengths(spark):
    df = spark.createDataFrame([("a",), ("ab",), ("abc",), ("abcd",)], "s string")
    row = distribution.string_length_analysis(df, "s").first()
    assert (row.empty_strings, row.single_char_strings, row.mean, row.p50) == (0, 1, 2.5, 2.5)


def test_correlations(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 6.0 - i, 3.0) for i in range(1, 6)], "a double, b double, c double, k double")
    pairs = by(distribution.correlation_pairs(df), "attribute1", "attribute2")
    assert pairs["a", "b"]["correlation"] == pytest.approx(1.0)
    assert pairs["a", "c"]["correlation"] == pytest.approx(-1.0)
    assert pairs["a", "k"]["correlation"] is None
    high = distribution.high_correlations(distribution.correlation_pairs(df)).collect()
    assert len(high) == 3 and {r.strength for r in high} == {"strong"}
    with pytest.raises(ValueError):
        distribution.correlation_pairs(df.select("a"))


def test_wide_correlation_equals_numpy_with_gaps(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(400, 12)) + 1e6
    data[:, 3] = data[:, 0] * 0.5 + rng.normal(size=400) * 0.1
    rows = [[None if rng.random() < 0.1 else float(v) for v in line] for line in data]
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    found = by(distribution.correlation_pairs(df), "attribute1", "attribute2")
    import pandas as pd

    expected = pd.DataFrame(rows, columns=names, dtype=float).corr()
    assert len(found) == 66
    for (a, b), row in found.items():
        assert row["correlation"] == pytest.approx(expected.loc[a, b], abs=1e-6)


# --- tails -----------------------------------------------------------------------------------------------------------


def test_student_tail():
    assert tails.student_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.student_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.student_two_sided(math.inf, 5) == 0.0
    assert tails.student_two_sided(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)


def test_kolmogorov_tail():
    # Published value: P(D_10 < 0.274) = 0.6284796154565.
    assert tails.kolmogorov_two_sided(0.274, 10) == pytest.approx(1 - 0.6284796154565, abs=1e-9)
    exact, series_form = tails.kolmogorov_two_sided(0.06, 400), tails.kolmogorov_two_sided(0.06, 401)
    assert exact == pytest.approx(series_form, abs=2e-3)
    assert tails.kolmogorov_two_sided(0.5, 5000) == pytest.approx(0.0, abs=1e-12)


def test_shapiro():
    # Published example: weights of eleven men.
    w, p = tails.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.78881, abs=1e-4) and p == pytest.approx(0.006704, abs=1e-4)
    w, p = tails.shapiro_wilk(np.random.default_rng(2).normal(size=3000))
    assert w > 0.99 and p > 0.01


def test_distribution_type(spark):
    assert distribution.distribution_type(numbers(spark, [1, 2]), "x").first().likely_distribution == "insufficient_data"
    rng = np.random.default_rng(4)
    uniform = distribution.distribution_type(numbers(spark, rng.random(500)), "x").first()
    assert uniform.likely_distribution == "uniform" and uniform.p_uniform > 0.01 and not uniform.is_normal
    exponential = distribution.distribution_type(numbers(spark, rng.exponential(size=500)), "x").first()
    assert exponential.likely_distribution == "exponential"
    normal = distribution.distribution_type(numbers(spark, rng.normal(size=500)), "x").first()
    assert normal.likely_distribution == "normal" and normal.is_normal


def test_kolmogorov_distance_with_a_hot_value(spark):
    values = np.concatenate([np.full(300, 0.5), np.random.default_rng(1).random(600)])
    row = distribution.kolmogorov_distances(numbers(spark, values), "x").first()
    x = np.sort(values)
    i = np.arange(1, 901)
    assert row.d_uniform == pytest.approx(max((i / 900 - x).max(), (x - (i - 1) / 900).max()))


# --- order ------------------------------------------------------------------------------------------------------------


def test_row_index_follows_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(9)
    rows = with_row_index(df, ["k"]).collect()
    assert len(rows) == 5000 and all(r.idx == r.k for r in rows)


def test_running_totals(spark):
    df = spark.range(3000).select((F.col("id") * 31 % 3000).alias("k")).repartition(6)
    rows = with_running_totals(df, ["k"], {"n": F.lit(1).cast("bigint"), "s": F.col("k").cast("double")}).collect()
    assert all(r.n == r.k + 1 and r.s == r.k * (r.k + 1) / 2 for r in rows)


def test_lags_across_chunks(spark):
    df = spark.range(500).select(F.col("id").alias("idx"), (F.col("id") * 3.0).alias("x"))
    rows = series.with_lags(df, [1, 7, 30], chunk=60).collect()
    assert len(rows) == 500
    for r in rows:
        for k in (1, 7, 30):
            assert r[f"lag_{k}"] == (None if r.idx < k else (r.idx - k) * 3.0)


def test_trend_of_a_line_and_a_constant(spark):
    line = series.ordered_series(numbers(spark, range(100)), "x", ["i"])
    row = series.linear_trend(line).first()
    assert (row.slope, row.r_squared, row.p_value, row.direction) == (1.0, 1.0, 0.0, "increasing")
    flat = series.linear_trend(series.ordered_series(numbers(spark, [4] * 20), "x", ["i"])).first()
    assert (flat.slope, flat.r_squared, flat.p_value, flat.direction) == (0.0, 0.0, 1.0, "stable")
    assert series.linear_trend(series.ordered_series(numbers(spark, [1, 2]), "x", ["i"])).first().message
    assert series.volatility(line).first().volatility == 0.0


def test_autocorrelation_against_numpy(spark):
    values = np.sin(np.arange(200) / 5) + np.random.default_rng(6).normal(size=200) * 0.2
    found = by(series.autocorrelation(series.ordered_series(numbers(spark, values), "x", ["i"])), "lag")
    assert set(found) == {7, 30}
    for k in (7, 30):
        assert found[k]["autocorrelation"] == round(float(np.corrcoef(values[:-k], values[k:])[0, 1]), 4)


def test_change_points_against_brute_force(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.normal(size=150), rng.normal(size=150) * 5])
    width = max(5, len(values) // 10)
    expected = [
        i
        for i in range(width, len(values) - width)
        if abs(values[i - width : i].var() - values[i : i + width].var()) > values.var() * 0.5
    ]
    found = sorted(r.idx for r in series.change_points(numbers(spark, values), "x", ["i"]).collect())
    assert found == expected and expected
    assert series.change_points(numbers(spark, range(19)), "x", ["i"]).count() == 0


def test_normal_quantiles_as_an_expression(spark):
    probabilities = [1e-300, 1e-12, 1e-5, 0.01, 0.07, 0.075, 0.2, 0.5, 0.6, 0.925, 0.93, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in probabilities], "p double")
    got = [r["x"] for r in df.selectExpr("p", f"{tails.normal_quantile_sql('p')} AS x").orderBy("p").collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in sorted(probabilities)], rel=1e-12, abs=1e-14)


@pytest.mark.parametrize("size", [4, 5, 6, 10, 11, 12, 400, 5000])
def test_shapiro_sums_over_global_ranks(spark, size):
    """Ties, a null, and many partitions give the statistic of the values at hand."""
    values = np.random.default_rng(size).gamma(3, 2, size).round(1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
    s = distribution.shapiro_sums(df, "x").first()
    assert s["n"] == size
    assert tails.shapiro_of_sums(s["n"], s["norm2"], s["scored"], s["spread"], tuple(s["ends"])) == pytest.approx(tails.shapiro_wilk(values), rel=1e-9)


def test_correlation_of_many_columns(spark):
    """Pairs inside and across batches of columns, with nulls and a constant column."""
    random = np.random.default_rng(1)
    x = random.normal(size=(300, 19))
    x[:, 5] = x[:, 2] * 2 + random.normal(size=300) * 0.1
    x[:, 18] = 7.0
    x[random.random((300, 19)) < 0.05] = np.nan
    names = [f"c.{i}" for i in range(19)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"`{n}` double" for n in names))
    got = {(r["attribute1"], r["attribute2"]): r["correlation"] for r in distribution.correlation_pairs(df).collect()}
    assert len(got) == 19 * 18 // 2
    for (a, b), r in got.items():
        i, j = names.index(a), names.index(b)
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        if 18 in (i, j):
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], rel=1e-9)
