import pytest
from pyspark.sql import functions as F

from datagauge.operators import keys, relations, tables
from datagauge.operators.profile import metadata_all
from datagauge.plans.dataset import table_positions

from .conftest import by


def test_overlap_across_types_ignores_falsy_values(spark):
    a = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "a_id int")
    b = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.5,)], "b_id double")
    c = spark.createDataFrame([("1",), ("",), ("2",)], "c_id string")
    found = by(keys.fk_candidates({"a": a, "b": b, "c": c}), "source_table", "target_table")
    assert set(found) == {("a", "b")}
    assert found["a", "b"]["matching_values"] == 2
    assert found["a", "b"]["confidence"] == pytest.approx(2 / 3)


def test_overlap_needs_different_names_and_tables(spark):
    a = spark.createDataFrame([(1, 1)], "x_id int, y_id int")
    b = spark.createDataFrame([(1, 1)], "x_id int, other int")
    found = by(keys.fk_candidates({"a": a, "b": b}), "source_field", "target_field")
    assert set(found) == {("y_id", "x_id")}


def test_overlap_of_more_columns_than_one_mask_holds(spark):
    wide = {
        t: spark.range(1, 20).select(*[(F.col("id") + n % 3).alias(f"{t}_id{n}") for n in range(40)]) for t in ("a", "b")
    }
    rows = keys.fk_candidates(wide).collect()
    assert len(rows) == 1600
    expected = {0: 19, 1: 18, 2: 17}
    for r in rows:
        shift = abs(int(r.source_field[4:]) % 3 - int(r.target_field[4:]) % 3)
        assert r.matching_values == expected[shift]


def test_common_attributes_in_table_order(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1, 2)], "y int, z int")
    assert [tuple(r) for r in keys.common_attributes({"a": a, "b": b}).collect()] == [("a", "b", "y")]


@pytest.fixture
def family(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    child = spark.createDataFrame([(1,), (1,), (2,), (9,), (9,), (None,)], "parent_id int")
    return child, parent


def test_orphan_rows_split_a_hot_key(spark, tmp_path):
    """The final adaptive plan of a child side whose rows nearly all have one key."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    hot = F.when(F.col("id") % 10 == 0, F.col("id") % 5000).otherwise(F.lit(-1))
    spark.range(60_000).select("id", hot.alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).repartition(8).write.parquet(str(tmp_path / "c"))
    spark.range(5000).write.parquet(str(tmp_path / "p"))
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = keys.orphan_rows(spark.read.parquet(str(tmp_path / "c")), "key", spark.read.parquet(str(tmp_path / "p")), "id")
        assert len(found.collect()) == 54_000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_orphans_and_integrity(family):
    child, parent = family
    assert [r.parent_id for r in keys.orphan_rows(child, "parent_id", parent, "id").collect()] == [9, 9]
    assert [tuple(r) for r in keys.orphan_keys(child, "parent_id", parent, "id").collect()] == [(9, 2)]
    rate = keys.integrity_rate(child, "parent_id", parent, "id").first()
    assert (rate.child_rows, rate.matched_rows, rate.orphan_keys, rate.integrity_rate) == (5, 3, 1, 60.0)


def test_cardinality(spark, family):
    child, parent = family
    row = keys.cardinality(child, "parent_id", parent, "id").first()
    assert (row.parent_keys, row.min_children, row.max_children, row.childless_parents, row.cardinality) == (3, 0, 2, 1, "1:n")
    one = spark.createDataFrame([(1,), (2,)], "k int")
    assert keys.cardinality(one, "k", one, "k").first().cardinality == "1:1"
    two = spark.createDataFrame([(1,), (1,)], "k int")
    assert keys.cardinality(two, "k", two, "k").first().cardinality == "n:m"
    assert keys.cardinality(one, "k", two, "k").first().cardinality == "n:1"


def test_component_sums_are_signed(spark):
    df = spark.createDataFrame(
        [("a", 185.43, 181.97, 15.47, 5.99, 18.0), ("b", 203.43, 181.97, 15.47, 5.99, 18.0)],
        "id string, total double, subtotal double, tax double, shipping double, discount double",
    )
    found = keys.component_sum_violations(df, "id", "total", ["subtotal", "tax", "shipping"], ["discount"]).collect()
    assert [r.key for r in found] == ["b"] and found[0].variance == pytest.approx(18.0)
    unsigned = keys.component_sum_violations(df, "id", "total", ["subtotal", "tax", "shipping"]).collect()
    assert [r.key for r in unsigned] == ["a"]


def profiles(spark):
    frames = {
        "orders": spark.createDataFrame([(1, None, "2020-01-01"), (2, 5, "x")], "id int, customer_id int, order_date string"),
        "customers": spark.createDataFrame([(5, "a", -3.0)], "id int, customer_name string, price double"),
        "order_log": spark.createDataFrame([("1", 200)], "id string, age int"),
    }
    return metadata_all(frames), table_positions(spark, list(frames))


def test_relationship_candidates(spark):
    rows = by(relations.relationship_candidates(*profiles(spark)), "child_table", "child_field", "parent_table", "parent_field")
    assert rows["orders", "id", "customers", "id"]["confidence"] == pytest.approx(0.8)
    assert rows["orders", "customer_id", "customers", "id"]["confidence"] == pytest.approx(0.9)
    # A text id is a whole number by vote, so it matches too.
    assert ("orders", "id", "order_log", "id") in rows
    assert ("orders", "order_date", "customers", "customer_name") not in rows


def test_foreign_key_nulls_count_once_per_later_table(spark):
    rows = relations.nullable_foreign_keys(*profiles(spark)).collect()
    assert {(r.field, r.table2, r.null_percentage) for r in rows} == {
        ("customer_id", "customers", 50.0), ("customer_id", "order_log", 50.0),
    }


def test_integrity_score(spark):
    row = relations.integrity_score(*profiles(spark)).first()
    assert row.violations == 2
    assert row.referential_integrity_score == round(max(0, 100 - 200 / row.relationships), 2)


def test_type_conflicts(spark):
    frames = {
        "a": spark.createDataFrame([("x",)], "start_date string"), "b": spark.createDataFrame([(1,)], "end_date int"),
    }
    rows = relations.inconsistent_types(metadata_all(frames), table_positions(spark, list(frames))).collect()
    assert [(r.field1, r.type1, r.field2, r.type2) for r in rows] == [("start_date", "string", "end_date", "integer")]


def test_business_rules(spark):
    rows = by(relations.business_rule_violations(profiles(spark)[0]), "rule", "table_name")
    assert rows["Critical Field Completeness", "orders"]["field"] == "customer_id"
    assert rows["Numeric Range Validation", "customers"]["field"] == "price"
    assert rows["Numeric Range Validation", "order_log"]["field"] == "age"
    assert ("Customer-Order Relationship", "order_log") in rows
    assert ("Customer-Order Relationship", "orders") not in rows


def test_schema_evolution(spark):
    a = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    b = spark.createDataFrame([(1,)], "a int")
    assert relations.schema_evolution(metadata_all({"a": a, "b": b})).first().schema_evolution_detected
    assert not relations.schema_evolution(metadata_all({"a": a, "b": a})).first().schema_evolution_detected


def test_schema_analysis_tells_missing_from_null(spark):
    docs = ['{"a":1,"b":null}'] * 9 + ['{"a":1}', '{"a":2,"c":3}']
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    row = tables.schema_summary(df, "j").first()
    assert (row.schema_consistency, row.unique_schemas, row.most_common_schema_attributes) == (81.82, 3, ["a", "b"])
    presence = by(tables.attribute_presence(df, "j"), "attribute")
    assert presence["a"]["is_required"] and not presence["a"]["is_optional"]
    assert presence["b"]["presence_rate"] == 81.82 and presence["b"]["is_optional"]
    assert presence["c"]["is_optional"]


def test_completeness_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("", None), ("a", 1), (None, 1)], "s string, n int")
    row = tables.record_completeness(df).first()
    assert (row.avg_completeness, row.records_100_complete, row.records_below_50_complete) == (62.5, 2, 1)
    dup = tables.duplicate_summary(df).first()
    assert (dup.total_duplicates, dup.duplicate_percentage, dup.unique_records) == (1, 25.0, 3)


def test_duplicates_tell_null_from_blank(spark):
    df = spark.createDataFrame([("", None), (None, "")], "a string, b string")
    assert tables.duplicate_summary(df).first().total_duplicates == 0


def test_freshness_sees_all_records(spark):
    rows = [(i, "2020-01-0%d" % (i % 9 + 1), None if i < 10 else "2021-01-01", "none") for i in range(20)]
    df = spark.createDataFrame(rows, "i int, seen string, late string, some_date string")
    found = by(tables.freshness(df), "field")
    assert set(found) == {"seen", "late"}
    assert (found["seen"]["earliest_date"], found["seen"]["latest_date"], found["seen"]["date_range_days"]) == (
        "2020-01-01", "2020-01-09", 8,
    )
    assert tables.date_fields(df) == ["seen", "late", "some_date"]


def test_table_scores_adjust_for_width(spark):
    df = spark.createDataFrame(
        [(t, f"c{i}", 10, 80.0, ["X"] if i == 0 else []) for t, n in (("small", 2), ("good", 5), ("wide", 51)) for i in range(n)],
        "table_name string, attribute string, total_count long, quality_score double, anomaly_flags array<string>",
    )
    rows = by(tables.table_scores(df), "table_name")
    assert [rows[t]["data_quality_score"] for t in ("small", "good", "wide")] == [80.0, 85.0, 75.0]
    assert rows["small"]["anomaly_rate"] == 50.0 and rows["good"]["affected_attributes"] == 1
