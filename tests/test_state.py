"""Merged profile states against the table they were made of."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from datagauge.operators.state import merge_states, profile_state, state_profile


@pytest.fixture(scope="module")
def df(spark):
    random = np.random.default_rng(4)
    rows = [(i, i % 11, float(x), None if i % 5 == 0 else f"name {i % 700}", "" if i % 3 == 0 else "abcde"[i % 5], 1e9 + i % 2) for i, x in enumerate(random.lognormal(0, 1, 20_000))]
    return spark.createDataFrame(rows, "id long, day int, x double, name string, letter string, far double").repartition(7)


def test_states_of_days_add_up_to_the_table(spark, df, tmp_path):
    days = profile_state(df, by=["day"], top=["letter", "name"])
    days.write.parquet(str(tmp_path / "states"))
    stored = spark.read.parquet(str(tmp_path / "states"))
    assert stored.count() == 11 * 5
    merged = {r["attribute"]: r for r in state_profile(merge_states(stored)).collect()}
    rows = df.collect()
    for name in ("id", "x", "far"):
        values = np.array([r[name] for r in rows])
        got = merged[name]
        assert (got["total_count"], got["null_count"], got["min_value"], got["max_value"]) == (20_000, 0, values.min(), values.max())
        assert got["mean"] == pytest.approx(values.mean(), rel=1e-12) and got["std"] == pytest.approx(values.std(), rel=1e-6)
        assert got["unique_estimate"] == pytest.approx(len(set(values)), rel=0.05)
        for p in (1, 5, 25, 50, 75, 95, 99):
            below, upto = (values < got[f"p{p}"]).mean(), (values <= got[f"p{p}"]).mean()
            assert below - 0.02 <= p / 100 <= upto + 0.02, (name, p)
    for name in ("name", "letter"):
        values = [r[name] for r in rows if r[name]]
        got = merged[name]
        assert got["present_count"] == len(values) and got["max_value"] == max(map(len, values)) and got["mean"] == pytest.approx(np.mean([len(v) for v in values]))
        counts = Counter(values)
        assert [t["count"] for t in got["top_values"]] == [n for _, n in counts.most_common(5)] and all(counts[t["item"]] == t["count"] for t in got["top_values"])
    assert merged["x"]["top_values"] is None


def test_merging_in_steps_gives_the_same(df):
    days = profile_state(df, ["x", "letter"], by=["day"], top=["letter"])
    once = {r["attribute"]: r for r in state_profile(merge_states(days)).collect()}
    halves = merge_states(days.withColumn("half", F.col("day") % 2), by=["half"])
    twice = {r["attribute"]: r for r in state_profile(merge_states(halves)).collect()}
    for name in once:
        for c in ("total_count", "present_count", "min_value", "max_value"):
            assert once[name][c] == twice[name][c]
        assert once[name]["std"] == pytest.approx(twice[name]["std"], rel=1e-9) and once[name]["unique_estimate"] == pytest.approx(twice[name]["unique_estimate"], rel=0.01)
    assert {tuple(t) for t in once["letter"]["top_values"]} == {tuple(t) for t in twice["letter"]["top_values"]}


def test_states_of_nothing(spark):
    none = spark.createDataFrame([(None, None), (None, "")], "x double, s string")
    got = {r["attribute"]: r for r in state_profile(merge_states(profile_state(none, top=["s"]).unionByName(profile_state(none.limit(0), top=["s"])))).collect()}
    assert got["x"]["total_count"] == 2 and got["x"]["present_count"] == 0 and got["x"]["mean"] is None and got["x"]["p50"] is None and got["x"]["std"] is None
    assert got["s"]["null_count"] == 2 and got["s"]["unique_estimate"] == 0 and not got["s"]["top_values"]
