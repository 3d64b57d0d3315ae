"""Profile of schema-free records, and quantiles, outliers and totals inside groups, against plain Python."""

import json
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from datagauge.operators.grouped import group_quantiles, outlier_counts_by_group, outlier_rows_by_group
from datagauge.operators.ordering import with_group_totals
from datagauge.operators.profile import profile
from datagauge.operators.records import TAGS, profile_variant

RECORDS = [
    {"a": 1, "b": "x", "email": "a@b.de"}, {"a": "2", "c": [1, 2]}, {"a": None, "b": ""}, {"a": 2.5, "c": []}, {"d": {"k": 1, "z": None}, "email": "no"},
    {"a": True, "c": "q"}, {"d": {}, "b": "1.5"}, {"d": {"y": [1]}, "b": "2", "late": False}, {"b": "3.5", "late": True}, {"late": "yes"}, {"late": 0}, {"c": [[], {}]},
    {"t": "7"}, {"t": 1.25}, {"n": -5}, {"n": 12345678901}, {"n": 7}, {"n": 7}, {"é ü": "日本 12"}, {}, {"x.y": None}, {"b`": "1e3"}, {"b`": "1_000"}, {"b`": " nan"},
]


def tag(v):
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "integer" if isinstance(v, int) else "float"
    if isinstance(v, str):
        try:
            float(v)
        except ValueError:
            return "string"
        return "float" if "." in v else "integer"
    return "array" if isinstance(v, list) else "object"


def text(v):
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False) if isinstance(v, (list, dict)) else str(v)


def number(v):
    try:
        return float(v)
    except (ValueError, TypeError):
        return None


def plain_profile(rows):
    out, values = {}, defaultdict(list)
    for r in rows:
        for k, v in r.items():
            values[k] += [v] if v is not None and v != "" else []
    for k, own in values.items():
        votes = Counter(tag(v) for v in own)  # keeps the order of first appearance
        kind = max(votes, key=votes.get) if votes else "unknown"
        found = {"data_type": kind, "total_count": len(rows), "present_count": len(own), "null_count": len(rows) - len(own), "unique_count": len({text(v) for v in own})}
        numbers = [x for x in map(number, own) if x is not None]
        if kind in ("integer", "float") and not any(math.isnan(x) for x in numbers):
            found |= {"min_value": min(numbers), "max_value": max(numbers), "mean": round(float(np.mean(numbers)), 4), "median": float(np.median(numbers)), "p95": round(float(np.percentile(numbers, 95)), 4)}
        if kind == "string":
            lengths = [len(text(v)) for v in own]
            found |= {"min_length": min(lengths), "max_length": max(lengths), "avg_length": round(float(np.mean(lengths)), 2), "median_length": float(np.median(lengths)), "length_p75": int(np.percentile(lengths, 75))}
        if kind == "array":
            lengths = [len(v) if isinstance(v, list) else 0 for v in own]
            found |= {"min_length": min(lengths), "max_length": max(lengths), "avg_length": round(float(np.mean(lengths)), 2), "median_length": float(np.median(lengths)), "empty_arrays": lengths.count(0)}
        if kind == "boolean":
            found |= {"true_count": sum(map(bool, own)), "false_count": len(own) - sum(map(bool, own))}
        if kind == "object":
            found |= {"unique_keys": len({x for v in own if isinstance(v, dict) for x in v}), "avg_keys_per_object": round(float(np.mean([len(v) if isinstance(v, dict) else 0 for v in own])), 2)}
        out[k] = found
    return out


def variants(spark, rows):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, j string").select("i", F.parse_json("j").alias("v"))


def test_profile_of_records_that_differ(spark):
    got = {r["attribute"]: r.asDict() for r in profile_variant(variants(spark, RECORDS), "v", order_by="i").collect()}
    expected = plain_profile(RECORDS)
    assert set(got) == set(expected)
    for k, own in expected.items():
        assert {n: got[k][n] for n in own} == own, k
    assert got["email"]["invalid_email_count"] == 1 and got["email"]["email_matches"] == 1 and got["x.y"]["data_type"] == "unknown"


def test_records_of_many_attributes_need_no_larger_plan(spark):
    rows = [{f"key{i}": i, f"other{i % 7}": "v"} for i in range(400)]
    df = profile_variant(variants(spark, rows), "v")
    assert df.count() == 407
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 400_000


def test_ties_go_by_first_appearance_or_a_fixed_order(spark):
    rows = [{"a": "x"}, {"a": 1}]
    assert profile_variant(variants(spark, rows), "v", order_by="i").first()["data_type"] == "string"
    assert profile_variant(variants(spark, rows), "v").first()["data_type"] == TAGS[0]


def test_records_that_are_no_objects_and_empty_tables(spark):
    assert profile_variant(variants(spark, [[1], 2, "x", None]), "v").count() == 0
    assert profile_variant(variants(spark, [{}]).where("i > 5"), "v").count() == 0


def test_tables_are_profiled_apart(spark):
    df = variants(spark, [{"a": 1}, {"a": "x", "b": 1}, {"b": 2}]).withColumn("of", F.when(F.col("i") == 0, "one").otherwise("two"))
    got = {(r["table_name"], r["attribute"]): (r["data_type"], r["total_count"], r["present_count"]) for r in profile_variant(df, "v", table_name="of").collect()}
    assert got == {("one", "a"): ("integer", 1, 1), ("two", "a"): ("string", 2, 1), ("two", "b"): ("integer", 2, 2)}


def test_profile_of_records_equals_the_typed_one(spark, sf_dir):
    typed = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    records = typed.select(F.parse_json(F.to_json(F.struct("*"))).alias("v"))
    columns = [c for c in profile(typed).columns if c not in ("min_date", "max_date")]
    expected = {r["attribute"]: r.asDict() for r in profile(typed).select(columns).collect()}
    got = {r["attribute"]: r.asDict() for r in profile_variant(records, "v").select(columns).collect()}
    assert set(got) == set(expected)
    for k in expected:
        for c in columns:
            a, b = got[k][c], expected[k][c]
            assert (a == pytest.approx(b, rel=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b) or c == "invalid_email_count", (k, c, a, b)


def grouped_rows():
    """A group that holds half the rows, one of one value, one of two, a null group, and ties."""
    random = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in random.normal(100, 5, 3000).round(2)] + [("hot", 400.0), ("hot", None), ("hot", -300.0)]
    rows += [("same", 4.0)] * 40 + [("one", 1.0), ("two", 1.0), ("two", 9.0), ("empty", None)]
    rows += [(None, float(x)) for x in random.integers(0, 9, 500)] + [(None, 50.0)] + [(f"g{i % 300}", float(i % 17)) for i in range(2000)]
    return rows


def test_group_quantiles(spark):
    rows = grouped_rows()
    df = spark.createDataFrame(rows, "g string, x double").repartition(16)
    wanted = (0.0, 0.25, 0.5, 0.99, 1.0)
    got = {r["g"]: (r["total"], r["quantiles"]) for r in group_quantiles(df, ["g"], {"x": F.col("x")}, wanted).collect()}
    groups = defaultdict(list)
    for g, x in rows:
        groups[g] += [x] if x is not None else []
    assert set(got) == {g for g, v in groups.items() if v}
    for g, (n, q) in got.items():
        assert n == len(groups[g]) and q == pytest.approx(np.quantile(groups[g], wanted).tolist(), rel=1e-12), g


def flags(values):
    x = np.array(values)
    if len(x) < 3:
        return [(False, False, False)] * len(x)
    q1, med, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    sd, mad = x.std(), np.median(np.abs(x - med))
    z = np.abs(x - x.mean()) / sd > 3 if sd else np.zeros(len(x), bool)
    m = np.abs(0.6745 * (x - med) / mad) > 3.5 if mad else np.zeros(len(x), bool)
    return list(zip(z, (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)), m))


def test_outliers_of_groups(spark):
    rows = [(i, g, x) for i, (g, x) in enumerate(grouped_rows())]
    df = spark.createDataFrame(rows, "i int, g string, x double")
    groups = defaultdict(list)
    for i, g, x in rows:
        groups[g] += [(i, x)] if x is not None else []
    expected = {i: f for own in groups.values() if own for (i, _), f in zip(own, flags([x for _, x in own])) if any(f)}
    got = {r["i"]: (r["is_z_score"], r["is_iqr"], r["is_modified_z_score"]) for r in outlier_rows_by_group(df, ["g"], "x").collect()}
    assert got == {i: tuple(map(bool, f)) for i, f in expected.items()}
    counts = {r["g"]: r["outlier_count"] for r in outlier_counts_by_group(df, ["g"], {"x": F.col("x")}).collect()}
    assert counts == {g: sum(i in expected for i, _ in own) for g, own in groups.items() if own}


def test_large_groups_are_spread_with_the_same_results(spark):
    """Groups on either side of the limit, null keys among both, in one table and apart."""
    rows = [(i, g, x) for i, (g, x) in enumerate(grouped_rows())]
    df = spark.createDataFrame(rows, "i int, g string, x double").repartition(16)
    values = {"x": F.col("x"), "neg": -F.col("x")}
    for make in (
        lambda whole: group_quantiles(df, ["g"], values, (0.0, 0.3, 1.0), whole=whole),
        lambda whole: outlier_counts_by_group(df, ["g"], values, whole=whole),
        lambda whole: outlier_rows_by_group(df, ["g"], "x", whole=whole),
    ):
        at_once, spread = [sorted(map(repr, make(whole).collect())) for whole in (10_000, 400)]
        assert at_once and spread == at_once


def test_outliers_of_groups_take_one_shuffle(spark):
    df = spark.createDataFrame([(i % 5, float(i)) for i in range(100)], "g int, x double")
    counts = outlier_counts_by_group(df, ["g"], {"x": F.col("x"), "neg": -F.col("x")})
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_totals_inside_groups(spark):
    """A key that holds most rows lies in several partitions, and its totals go on from one to the next."""
    rows = [("b", i, 1) for i in range(5000)] + [("a", i, 2) for i in range(7)] + [(None, i, 1) for i in range(600)] + [(f"k{i}", 0, 5) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, w int").repartition(11)
    got = with_group_totals(df, ["k"], ["i"], {"rows": F.lit(1).cast("bigint"), "sum": F.col("w")}).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["rows"] == r["i"] + 1 and r["sum"] == (r["i"] + 1) * r["w"]
