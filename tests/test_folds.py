import numpy as np
import pytest

from datagauge.operators import folds, profile

from .conftest import by


def test_profile_of_short_and_long_texts(spark):
    texts = ["a1", "a1", "", None, "7", "7.5", "b" * folds.SHORT_TEXT, "c" * 100, "c" * 100, "1" * 90]
    rows = by(profile.profile(spark.createDataFrame([(t, i % 3) for i, t in enumerate(texts)], "s string, k int")), "attribute")
    held = [t for t in texts if t]
    assert (rows["s"]["total_count"], rows["s"]["present_count"], rows["s"]["unique_count"]) == (10, len(held), len(set(held)))
    lengths = [len(t) for t in held]
    assert rows["s"]["data_type"] == "string" and rows["s"]["max_length"] == 100
    assert rows["s"]["avg_length"] == pytest.approx(np.mean(lengths), abs=0.006)
    assert rows["s"]["std_length"] == pytest.approx(np.std(lengths), abs=0.006)
    assert rows["s"]["median_length"] == np.median(lengths)
    assert rows["k"]["mean"] == pytest.approx(np.mean([i % 3 for i in range(10)]), abs=1e-4)


def test_numbers_in_texts_weigh_their_rows(spark):
    values = [1000000.0 + v for v in [1, 1, 1, 2, 3, 9, 500]]
    row = profile.profile(spark.createDataFrame([(str(v),) for v in values], "s string")).first()
    assert row.data_type == "float"
    assert row["mean"] == pytest.approx(np.mean(values), abs=1e-4) and row["std"] == pytest.approx(np.std(values), abs=1e-4)
    assert row["outlier_count"] == 2


def test_quantiles_of_folded_values(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 2, float(x), int(n)) for i, (x, n) in enumerate(zip(rng.integers(0, 50, 400), rng.integers(1, 5, 400)))]
    found = folds.folded_column_quantiles(spark.createDataFrame(rows, "nth int, x double, n bigint").repartition(5), (0.0, 0.3, 0.5, 1.0))
    for nth in (0, 1):
        values = np.repeat([x for k, x, _ in rows if k == nth], [n for k, _, n in rows if k == nth])
        assert found[nth] == (len(values), pytest.approx(np.quantile(values, (0.0, 0.3, 0.5, 1.0))))
