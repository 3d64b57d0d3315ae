import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datagauge.operators.extract_json import extract_json
from datagauge.operators.profile import profile
from datagauge.plans import dataset, reports
from datagauge.sources import files, nested

from .conftest import by

# A harbour's log: ships with voyages, which have cargo; a crane list without objects; an empty list.
DOCUMENT = {
    "harbour": "North", "opened": 1904,
    "ships": [
        {"hull": 11, "flag": "NO", "voyages": [{"leg": 1, "cargo": [{"good": "salt", "tons": 4.5}]}, {"leg": 2, "cargo": []}]},
        {"hull": 12, "voyages": [{"leg": 1, "cargo": [{"good": "rope", "tons": 0.5}, {"good": "tar", "tons": 2.0}]}]},
        {"hull": 13, "flag": "SE"},
    ],
    "cranes": ["A", "B"],
    "berths": [{"nr": 1}, {"nr": 2, "depth": 9}, {"nr": 3}, {"nr": 4}],
    "closed": [],
}
SIZES = {"main_table": 1, "ships": 3, "ships_voyages": 3, "ships_voyages_cargo": 3, "berths": 4}


def write(folder, name, text):
    path = os.path.join(str(folder), name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_typed_nested_tables(spark, tmp_path):
    path = write(tmp_path, "d.json", json.dumps(DOCUMENT, indent=1))
    found = nested.extract_tables(files.read_table(spark, path))
    assert {n: df.count() for n, df in found.items()} == SIZES
    assert {r.good for r in found["ships_voyages_cargo"].collect()} == {"salt", "rope", "tar"}
    lineage = nested.extract_tables(files.read_table(spark, path), lineage=True)["ships_voyages_cargo"]
    assert sorted((r.good, r._parent_ordinal) for r in lineage.collect()) == [("rope", 0), ("salt", 0), ("tar", 1)]


def test_variant_nested_tables_drop_scalars_of_mixed_lists(spark, tmp_path):
    notices = ["fog", {"wind": 7}, 12, {"wind": 3, "gusts": True}, None, {"ice": False}]
    mixed = {**DOCUMENT, "notices": notices, "plan": [[{"x": 1}], [{"x": 2}, {"x": 3}], []], "pilot": None}
    path = write(tmp_path, "m.json", json.dumps(mixed))
    found = nested.extract_variant_tables(files.read_json_variant(spark, path), "v")
    sizes = {r.table_name: r["count"] for r in found.groupBy("table_name").count().collect()}
    assert sizes == {**SIZES, "notices": 3, "plan": 3}


def test_list_root(spark, tmp_path):
    rows = [{"id": 1, "tags": [{"tagId": "t1"}]}, {"id": 2, "tags": [{"tagId": "t2"}]}]
    path = write(tmp_path, "l.json", json.dumps(rows))
    found = nested.extract_tables(files.read_table(spark, path))
    assert {n: df.count() for n, df in found.items()} == {"main_table": 2, "tags": 2}
    assert files.read_json_variant(spark, path).count() == 2


def test_scalar_root(spark, tmp_path):
    path = write(tmp_path, "s.json", "42")
    assert files.read_json_variant(spark, path).select(F.to_json("v")).first()[0] == '{"value":42}'


def test_same_name_merges(spark):
    df = spark.sql("SELECT array(named_struct('a', 1)) AS x_y, named_struct('y', array(named_struct('b', 2))) AS x")
    rows = nested.extract_tables(df)["x_y"].collect()
    assert sorted((r.a or 0, r.b or 0) for r in rows) == [(0, 2), (1, 0)]


@pytest.mark.parametrize("path, name", [([], "main_table"), (["a", "b"], "a_b"), (["a b", "c-d"], "a_b_c_d"), (["--"], "table")])
def test_table_names(spark, path, name):
    assert nested.table_name(path) == name
    df = spark.createDataFrame([(path,)], "p array<string>")
    assert df.select(nested.table_name_column(F.col("p"))).first()[0] == name


def test_report_paths(spark):
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(
        {"db": {"tables": {"orders": [{"id": 1}]}, "totals": {"n": 1, "m": 2}, "index": ["a", "b"], "deep": {"a": {"b": {"c": {"d": [{"x": 1}]}}}}}}
    )]))
    found = nested.report_tables(df)
    assert set(found) == {"db_tables_orders", "db_totals", "db_index", "db_deep_a_b_c_d"}
    assert set(nested.report_tables(df, max_depth=3)) == {"db_tables_orders", "db_totals", "db_index"}
    assert [r["0"] for r in found["db_index"].collect()] == ["a", "b"]
    hierarchy = by(nested.path_hierarchy(spark.createDataFrame([("db_index",), ("db",)], "p string"), "p"), "p")
    assert (hierarchy["db_index"]["parent"], hierarchy["db_index"]["level"]) == ("db", 1)
    assert (hierarchy["db"]["parent"], hierarchy["db"]["level"]) == (None, 0)


def test_multi_table_test():
    row = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType())]))
    one = T.StructType([T.StructField("t", row), T.StructField("s", T.StringType())])
    assert not nested.is_multi_table(one)
    assert nested.is_multi_table(T.StructType([*one.fields, T.StructField("u", row)]))


def test_csv_trims_names_and_counts_bad_lines(spark, tmp_path):
    path = write(tmp_path, "c.csv", " a , b\n1,x\n2,y,z\n3,\n4\n")
    df = files.read_table(spark, path)
    assert df.columns == ["a", "b"]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x"), (3, None)]
    assert sorted(r.line for r in files.malformed_csv(spark, path).collect()) == ["2,y,z", "4"]


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'k,v\n1,"he said ""x"", ok"\n2,"a\nb"\n3,""\n4,\n')
    assert [tuple(r) for r in files.read_table(spark, path).orderBy("k").collect()] == [(1, 'he said "x", ok'), (2, "a\nb"), (3, ""), (4, None)]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_separator(spark, tmp_path, sep):
    path = write(tmp_path, "s.csv", sep.join(["a", '"b,;|"', "c"]) + "\n" + sep.join("123") + "\n")
    assert [tuple(r) for r in files.read_table(spark, path).collect()] == [(1, 2, 3)]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, ' a "b" '), (2, ""), (3, None), (4, "x,y\nz\r\nw"), (5, '"'), (6, "\\")]
    files.write_csv(spark.createDataFrame(rows, "k int, v string"), str(tmp_path / "r.csv"))
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "r.csv")).orderBy("k").collect()] == rows


def test_json_forms(spark, tmp_path):
    rows = [{"k": 1, "v": "a\nb"}, {"k": 2, "v": None}, {"k": 3, "v": ""}]
    lines = write(tmp_path, "lines.json", "\n\n" + "\n".join(json.dumps(r) for r in rows) + "\n")
    array = write(tmp_path, "array.json", json.dumps(rows, indent=2))
    flat_array = write(tmp_path, "flat.json", json.dumps(rows))
    for path in (lines, array, flat_array):
        assert [(r.k, r.v) for r in files.read_table(spark, path).orderBy("k").collect()] == [(1, "a\nb"), (2, None), (3, "")]
    one = write(tmp_path, "one.json", json.dumps(rows[0], indent=2))
    assert files.read_table(spark, one).count() == 1
    bad = write(tmp_path, "bad.json", '{"k": 1}\n{"k": \n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        files.read_table(spark, bad).collect()


def test_xml_attributes_and_text(spark, tmp_path):
    path = write(tmp_path, "x.xml", '<rows><row id="1"><n>5</n></row><row id="2"><n unit="m">6</n></row></rows>')
    df = files.read_table(spark, path, row_tag="row")
    whole = nested.extract_tables(files.read_table(spark, path))
    assert {n: t.count() for n, t in whole.items()} == {"main_table": 1, "row": 2}
    rows = [r.asDict(recursive=True) for r in df.orderBy("`@id`").collect()]
    assert [r["@id"] for r in rows] == ["1", "2"]
    assert rows[1]["n"] == {"#text": "6", "@unit": "m"}


def test_unknown_extension(spark):
    with pytest.raises(ValueError, match="Unsupported file format: .unsupported"):
        files.read_table(spark, "file.unsupported")


def test_inventory(spark, tmp_path):
    write(tmp_path, "a.json", "{}")
    write(tmp_path, "b.unsupported", "xxxx")
    rows = by(files.file_inventory(spark, str(tmp_path)), "filename")
    assert rows["a.json"]["is_supported"] and not rows["b.unsupported"]["is_supported"]
    assert rows["b.unsupported"]["size_bytes"] == 4 and rows["b.unsupported"]["extension"] == ".unsupported"


def test_preview(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k int, v string").repartition(4)
    rows = by(files.preview({"t": df}, {"t": ["k"]}, 3), "position")
    assert len(rows) == 3 and rows[0]["record_count"] == 20 and rows[0]["columns"] == "k,v"
    assert json.loads(rows[2]["record"]) == {"k": 2, "v": "v2"}


@pytest.mark.parametrize(
    "text, method, found",
    [
        ('Sure:\n```json\n{"a": 1}\n```', "json_fence", '{"a": 1}'),
        ("```json\nnot json\n```", "json_fence", "not json"),
        ('```\n[1, 2]\n```', "plain_fence", "[1, 2]"),
        ('x {"a": {"b": 2}} y', "brace_span", '{"a": {"b": 2}}'),
        ('{"a": 1} and } more', "balanced_braces", '{"a": 1}'),
        ('{bad} Result: {"a": 1} }', None, None),
        ('{bad} here is: {"a": 1}', "intro_phrase", '{"a": 1}'),
        ('no json at all', None, None),
        ('} {', None, None),
        ('{bad} {"a": 1} this is it', None, None),
        ('} x {"a": 1} } json: {"b": [1]}', "balanced_braces", '{"a": 1}'),
        ('```json{"a": 1}```', "json_fence", '{"a": 1}'),
        ('{ {"a": 1} ', None, None),
        ('Result: {x} Result: {"a": 1}', None, None),
        ('{no} analysis:\n{"a": 1}\n', "intro_phrase", '{"a": 1}'),
    ],
)
def test_json_in_text(spark, text, method, found):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    rows = [(r.method, r.json_text) for r in extract_json(df, "id", "t").collect()]
    assert rows == ([(method, found)] if method else [])


def test_json_in_long_texts(spark):
    """A megabyte on which searches that start anew at every place would not end."""
    size = 1 << 20
    plain, blank = "word and more. " * (size // 15), " " * size
    texts = {
        "braces": "{" * size, "closing": "}{" * (size // 2), "tail": '{bad} {"a": 1} ' + plain, "no end": "result: { " * (size // 10),
        "phrases": "x } " + "result: {" * (size // 9), "behind": "{x " * (size // 3) + "} this was", "fence": "```json" + blank, "fences": "```" + blank + "x" + blank,
        "blank": '```json\n{"a": ' + blank + "1}" + blank + "```", "found": plain + 'not {this} but the result: {"a": 1} ' + plain, "nested": "x } " + "{[" * (size // 4),
    }
    start = time.monotonic()
    df = spark.createDataFrame(list(texts.items()), "id string, t string").repartition(8)
    found = {r.id: (r.method, r.json_text) for r in extract_json(df, "id", "t").collect()}
    assert time.monotonic() - start < 60
    assert found == {"closing": ("balanced_braces", "{}"), "blank": ("json_fence", '{"a": ' + blank + "1}"), "found": ("intro_phrase", '{"a": 1}')}


def test_scorecard_of_a_clean_table(spark):
    df = spark.createDataFrame([("A-1", "2020")], "order_id string, note string")
    card = reports.scorecard(profile(df, "orders"))
    rows = by(reports.scorecard_rows(card), "Metric")
    assert [rows[m]["Score"] for m in ("Completeness", "Consistency", "Accuracy", "Validity", "Uniqueness", "Timeliness", "Overall Quality")] == [
        "100.0%", "100.0%", "100.0%", "100.0%", "100.0%", "95.0%", "99.2%",
    ]
    assert rows["Overall Quality"]["Details"] == "High quality dataset"
    assert rows["Completeness"]["Recommendation"] == "Maintain current standards"


def test_column_report(spark):
    df = spark.createDataFrame(
        [(1, "a@x.org", "Ann", 1.5, True, ["p"]), (2, "b@y.org", "Bob", 2.5, False, ["q"])],
        "id int, email string, username string, price double, ok boolean, tags array<string>",
    )
    rows = by(reports.column_report(df, profile(df), ["id"]), "Column")
    assert (rows["id"]["Data_Type"], rows["id"]["Pattern"]) == ("INTEGER", "Sequential")
    assert (rows["email"]["Data_Type"], rows["email"]["Pattern"]) == ("VARCHAR", "Email format")
    assert rows["email"]["Anomalies_Detected"] == "Different domains (personal vs corporate)"
    assert rows["username"]["Pattern"] == "Alphanumeric"
    assert (rows["price"]["Data_Type"], rows["price"]["Pattern"]) == ("DECIMAL", "Currency")
    assert (rows["ok"]["Data_Type"], rows["ok"]["Pattern"]) == ("BOOLEAN", "Boolean")
    assert (rows["tags"]["Data_Type"], rows["tags"]["Pattern"]) == ("ARRAY", "Fixed values")


def test_sequential_skips_nulls_and_needs_order(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, None, 3), (3, 6, 2), (4, 7, 4)], "o int, gaps int, swapped int")
    assert reports.sequential_columns(df, ["o"]) == ["o", "gaps"]


def test_write_report(spark, tmp_path):
    people = spark.createDataFrame(
        [(10, "Ann Lee", "ann@corp.org", 30), (11, "Bob Ray", "bob@corp.org", 41)], "id int, name string, email string, age int"
    )
    out = str(tmp_path / "out")
    result = dataset.write_report({"people": people}, {"people": ["id"]}, out, "2024-12-31")
    assert result.summary.first().total_tables == 1
    assert result.corrected["people"].first().quality_grade in "ABCDF"
    quality = spark.read.csv(f"{out}/people_quality_assessment", header=True)
    assert quality.count() == 7 and quality.columns == ["Metric", "Score", "Details", "Recommendation"]
    assert spark.read.csv(f"{out}/people_original", header=True).count() == 2
    assert spark.read.csv(f"{out}/people_enriched_metadata_anomalies", header=True).count() == 4
    assert spark.read.json(f"{out}/profiles").count() == 4
