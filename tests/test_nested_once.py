from pyspark.sql import functions as F

from datagauge.sources import nested


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nested_variants_are_parsed_once(spark):
    docs = ['{"a": [{"b": 1}, null, {"b": "x<y"}], "c": {"d": [{"e": [{"f": 1}, 2]}, [{"g": {}}]]}}', '[{"b": 2}, {"VARIANT": 1}]', "5", None]
    df = spark.createDataFrame([(d,) for d in docs], "j string").select(F.parse_json("j").alias("v"))
    found = nested.extract_variant_tables(df, "v")
    got = sorted((r.table_name, r.j) for r in found.select("table_name", F.to_json("record").alias("j")).collect())
    main = ('main_table', '{"a":[{"b":1},null,{"b":"x<y"}],"c":{"d":[{"e":[{"f":1},2]},[{"g":{}}]]}}')
    assert got == sorted([
        main, ("main_table", '{"b":2}'), ("main_table", '{"VARIANT":1}'), ("a", '{"b":1}'), ("a", '{"b":"x<y"}'),
        ("c_d", '{"e":[{"f":1},2]}'), ("c_d", '{"g":{}}'), ("c_d_e", '{"f":1}'),
    ])
    assert "parseJson" not in plan(found)
