"""Report tables of schema-free documents against a plain walk."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from datagauge.sources import nested

DOCS = [
    {"a": [{"x": 1}, {"y": 2}], "b": [1, "2", 3.5, True], "c": {"k": 1, "n": None}, "d": {"e": {"f": [1]}, "g": 5}, "s": "text", "z": None},
    {"m": [1, {"p": {"q": 1}}, {"flat": 1}, {"r": [2], "t": {"u": [{}]}}], "l": [[1, 2], [{"v": [1]}, 3], [[{"w": {"x": [1, 2, 3]}}]]], "h": [None, 1], "e": [], "o": {}, "oo": {"o": {}}},
    [{"a": [1, 2]}, 5, {"b": {"c": 1}, "d": {"e": [{"f": 1}]}}, [{"g": [1]}], {"h": 2}],
    [], 5, "text", None, {}, {"k": {"l": {"m": {"n": {"o": {"p": [1, 2]}}}}}}, {"é ü": [1], "x.y": [{"a": 1}], "": {"b": 1}},
]


def scalar(v, null=False):
    return isinstance(v, (str, int, float, bool)) or (null and v is None)


def shape(v):
    if isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
        return "records"
    if isinstance(v, list) and v and all(map(scalar, v)):
        return "values"
    return "record" if isinstance(v, dict) and v and all(scalar(x, True) for x in v.values()) else None


def walk(v, path="", depth=0, most=None, lists=False):
    if most is not None and depth >= most:
        return
    if isinstance(v, dict):
        for key, value in v.items():
            here = f"{path}_{key}" if path else key
            if shape(value):
                yield here, value
            elif isinstance(value, dict):
                yield from walk(value, here, depth + 1, most, lists)
            elif isinstance(value, list):
                yield from items(value, here, depth, most, lists)
    elif isinstance(v, list):
        for i, item in enumerate(v):
            if isinstance(item, dict):
                yield from walk(item, f"item_{i}", depth + 1, most, lists)


def items(value, here, depth, most, lists):
    for i, item in enumerate(value):
        if isinstance(item, dict) and not shape(item):
            yield from walk(item, f"{here}_{i}", depth + 1, most, lists)
        elif isinstance(item, list) and lists:
            if shape(item):
                yield f"{here}_{i}", item
            else:
                yield from items(item, f"{here}_{i}", depth, most, lists)


@pytest.mark.parametrize("most, lists", [(None, False), (None, True), (1, False), (2, False), (5, True)])
def test_report_tables_of_documents(spark, most, lists):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "i int, j string").select("i", F.parse_json("j").alias("v"))
    got = Counter((r["id"], r["table_path"], r["shape"], r["position"], r["j"]) for r in nested.report_variant(df, "v", "i", most, lists).withColumn("j", F.to_json("record")).collect())
    expected = Counter()
    for i, d in enumerate(DOCS):
        for path, value in walk(d, most=most, lists=lists):
            for n, record in enumerate(value if isinstance(value, list) else [value]):
                expected[i, path, shape(value), n, json.dumps(record, separators=(",", ":"), ensure_ascii=False, sort_keys=True)] += 1
    assert got == expected


def test_documents_without_tables(spark):
    df = spark.createDataFrame([("a", "5"), ("b", None)], "i string, j string").select("i", F.parse_json("j").alias("v"))
    assert nested.report_variant(df, "v", "i").count() == 0
    assert nested.report_variant_inventory(df, "v", "i").columns == ["id", "table_path", "shape", "records"]
