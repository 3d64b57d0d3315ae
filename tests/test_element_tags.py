from datagauge.operators import profile


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_element_types_tags_once(spark):
    df = spark.createDataFrame([('[1, "x", null, 2.5, [1], {"a": 1}, true, "3"]',), ("no json",), (None,)], "j string")
    found = profile.element_types(df, "j")
    assert {r.element_type: r.n for r in found.collect()} == {"integer": 2, "string": 1, "float": 1, "array": 1, "object": 1, "boolean": 1, None: 1}
    assert plan(found.where("element_type IS NOT NULL")).count("schemaOfVariant") == 1
