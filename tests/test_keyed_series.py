"""A series for each key against the operators on each key alone."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from datagauge.operators import keyed_series, series


@pytest.fixture(scope="module")
def rows():
    """A key with half of all rows and a change of spread, a null key, short and constant ones."""
    random = np.random.default_rng(2)
    out = [("hot", i, float(x)) for i, x in enumerate(np.concatenate([random.normal(0, 1, 2500), random.normal(5, 4, 2500)]).round(3))]
    out += [(None, i, i * 0.5 + float(x)) for i, x in enumerate(random.normal(0, 1, 400))]
    out += [(f"k{k}", i, float(x)) for k in range(40) for i, x in enumerate(random.integers(0, 50, 5 + 5 * k % 120))]
    out += [("constant", i, 3.0) for i in range(50)] + [("one", 0, 1.0)] + [("gaps", i, None if i % 3 else float(i % 8)) for i in range(90)]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, t int, v double").repartition(13)


@pytest.fixture(scope="module")
def keyed(df):
    return keyed_series.keyed_series(df, ["k"], "v", ["t"])


def alone(spark, rows, keys):
    for key in keys:
        own = [(t, v) for k, t, v in rows if k == key]
        yield key, spark.createDataFrame(own, "t int, v double")


def near(a, b):
    return a == b or (a is not None and b is not None and a == pytest.approx(b, rel=1e-6, abs=2e-4))


KEYS = ("hot", None, "k3", "constant", "one", "gaps")


def test_positions_inside_keys(keyed, rows):
    expected = {(k, t): v for k, t, v in rows}
    got = {(r["k"], r["idx"]): r["x"] for r in keyed.collect()}
    assert got == expected


def test_trend_of_each_key(spark, keyed, rows):
    got = {r["k"]: r for r in keyed_series.trend_by_key(keyed, ["k"]).collect()}
    assert set(got) == {k for k, _, _ in rows}
    for key, own in alone(spark, rows, KEYS):
        expected = series.linear_trend(series.ordered_series(own, "v", ["t"])).first()
        assert all(near(got[key][c], expected[c]) if c not in ("direction", "message") else got[key][c] == expected[c] for c in expected.asDict()), key


@pytest.mark.parametrize("chunk", [1 << 18, 100])
def test_lags_of_each_key(spark, keyed, rows, chunk):
    found = defaultdict(dict)
    for r in keyed_series.autocorrelation_by_key(keyed, ["k"], (1, 7, 30), chunk).collect():
        found[r["k"]][r["lag"]] = r["autocorrelation"]
    steps = {r["k"]: r["volatility"] for r in keyed_series.volatility_by_key(keyed, ["k"], chunk).collect()}
    for key, own in alone(spark, rows, KEYS):
        one = series.ordered_series(own, "v", ["t"])
        expected = {r["lag"]: r["autocorrelation"] for r in series.autocorrelation(one, (1, 7, 30)).collect()}
        assert set(found[key]) == set(expected) and all(near(found[key][lag], expected[lag]) for lag in expected), key
        assert near(steps[key], series.volatility(one).first()["volatility"]), key


def test_change_points_of_each_key(spark, df, rows):
    found = defaultdict(dict)
    for r in keyed_series.change_points_by_key(df, ["k"], "v", ["t"]).collect():
        found[r["k"]][r["idx"]] = (r["left_var"], r["right_var"])
    assert 2300 < max(found["hot"], key=lambda i: abs(found["hot"][i][0] - found["hot"][i][1])) < 2700 or len(found["hot"]) > 100
    for key, own in alone(spark, rows, KEYS[:-1]):
        expected = {r["idx"]: (r["left_var"], r["right_var"]) for r in series.change_points(own, "v", ["t"]).collect()}
        assert set(found[key]) == set(expected), key
        assert all(near(a, b) for i in expected for a, b in zip(found[key][i], expected[i]))


def test_a_hot_key_lies_in_several_partitions(spark, df):
    """Nothing is partitioned by the key alone."""
    plan = keyed_series.autocorrelation_by_key(keyed_series.keyed_series(df, ["k"], "v", ["t"]), ["k"], (1,), 100)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "chunk" in line or "_pid" in line


def test_empty_table_and_several_keys(spark, df):
    empty = df.where("t < 0")
    assert keyed_series.trend_by_key(keyed_series.keyed_series(empty, ["k"], "v", ["t"]), ["k"]).count() == 0
    assert keyed_series.change_points_by_key(empty, ["k"], "v", ["t"]).count() == 0
    two = df.withColumn("half", F.col("t") % 2)
    got = keyed_series.keyed_series(two, ["k", "half"], "v", ["t"]).groupBy("k", "half").agg(F.max("idx").alias("m"), F.count("*").alias("n"))
    assert got.where("m + 1 <> n").count() == 0
