import pytest
from pyspark.sql import functions as F

from datagauge.functions.numbers import to_number, value_tag
from datagauge.functions.text import matches
from datagauge.operators import frequency, profile
from datagauge.params import PATTERNS, Thresholds

from .conftest import by


def frame(spark, column, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"{column} {kind}")


def test_nulls_are_missing_and_empty_only(spark):
    df = frame(spark, "v", [None, "", " ", "0", "False"])
    row = by(profile.profile(df), "attribute")["v"]
    assert (row["total_count"], row["present_count"], row["null_count"]) == (5, 3, 2)
    assert row["null_percentage"] == 40.0
    assert row["unique_count"] == 3 and row["unique_ratio"] == 1.0


@pytest.mark.parametrize(
    "text, number, tag",
    [
        ("1e5", 100000.0, "integer"),
        (" 7 ", 7.0, "integer"),
        ("1_000", 1000.0, "integer"),
        ("1d", None, "string"),
        ("1.", 1.0, "float"),
        (".5", 0.5, "float"),
        ("-2.5E-1", -0.25, "float"),
        ("1__0", None, "string"),
        ("_1", None, "string"),
        ("abc", None, "string"),
        ("", None, None),
        ("0x10", None, "string"),
        ("Infinity", float("inf"), "integer"),
    ],
)
def test_number_grammar(spark, text, number, tag):
    df = frame(spark, "v", [text])
    row = df.select(to_number(F.col("v")).alias("n"), value_tag(F.col("v")).alias("t")).first()
    assert (row.n, row.t) == (number, tag)


def test_nan_is_a_number_word(spark):
    row = frame(spark, "v", ["nan"]).select(value_tag(F.col("v")).alias("t")).first()
    assert row.t == "integer"


def test_type_vote_tie_goes_to_first_seen(spark):
    df = spark.createDataFrame([(1, "a"), (2, "1"), (3, "b"), (4, "2")], "o int, v string")
    assert [r.type_tag for r in profile.type_vote(df, "v", "o").collect()] == ["string", "integer"]


def test_variant_vote(spark):
    df = spark.sql(
        "SELECT o, parse_json(j) AS v FROM VALUES (1,'1'),(2,'2.5'),(3,'1e3'),(4,'\"7\"'),(5,'true'),(6,'[1]'),(7,'{}'),(8,'null'),(9,'\"x\"') t(o, j)"
    )
    votes = {r.type_tag: r.votes for r in profile.type_vote(df, "v", "o").collect()}
    assert votes == {"integer": 2, "float": 2, "boolean": 1, "array": 1, "object": 1, "string": 1}


def test_numeric_strings_are_profiled_as_numbers(spark):
    row = by(profile.profile(frame(spark, "v", ["1.5", "2.5", "3.5", "n/a"])), "attribute")["v"]
    assert row["data_type"] == "float"
    assert (row["min_value"], row["max_value"], row["mean"], row["median"]) == (1.5, 3.5, 2.5, 2.5)
    assert row["min_length"] is None


def test_all_null_column_is_unknown(spark):
    row = by(profile.profile(frame(spark, "v", [None, None], "double")), "attribute")["v"]
    assert row["data_type"] == "unknown" and row["null_percentage"] == 100.0
    assert row["anomaly_flags"] == ["HIGH_NULL_RATE"]


def test_charset_shares(spark):
    row = by(profile.profile(frame(spark, "v", ["aé1²½  €!", "b"])), "attribute")["v"]
    # 3 letters, 2 digits, 1 other number, 2 blanks, 1 non-ASCII sign, 1 sign
    shares = [row[c + "_pct"] for c in ("alphabetic", "numeric", "alphanumeric", "whitespace", "unicode", "special_chars")]
    assert shares == [30.0, 20.0, 10.0, 20.0, 10.0, 10.0]
    assert abs(sum(shares) - 100) < 0.05


@pytest.mark.parametrize(
    "pattern, good, bad",
    [
        ("email", "a.b@c.org", "a@b"),
        ("phone", "(555) 123-4567", "555-123"),
        ("date_iso", "2023-01-02", "2023-1-2"),
        ("url", "https://a.b/c", "ftp://a"),
        ("ip_address", "10.0.0.1", "10.0.0"),
        ("credit_card", "1234 5678 1234 5678", "1234 5678"),
    ],
)
def test_patterns(spark, pattern, good, bad):
    df = frame(spark, "v", [good, good + "\n", bad, "x" + good])
    found = [r[0] for r in df.select(matches(F.col("v"), PATTERNS[pattern])).collect()]
    assert found[:3] == [True, True, False]
    counts = by(profile.pattern_counts(df), "attribute", "pattern")
    assert counts["v", pattern]["matches"] >= 2


def test_dominant_pattern_defaults_to_the_first(spark):
    rows = by(profile.profile(frame(spark, "v", ["x", "y"])), "attribute")
    assert rows["v"]["dominant_pattern"] == "email"


@pytest.mark.parametrize("nulls, flagged", [(30, False), (31, True)])
def test_null_flag_limit(spark, nulls, flagged):
    df = frame(spark, "v", [None] * nulls + [f"value{i}" for i in range(100 - nulls)])
    row = by(profile.profile(df), "attribute")["v"]
    assert ("HIGH_NULL_RATE" in row["anomaly_flags"]) is flagged


@pytest.mark.parametrize("values, distinct, flagged", [(10, 1, False), (11, 1, True), (20, 2, False)])
def test_uniqueness_flag_limit(spark, values, distinct, flagged):
    df = frame(spark, "v", [f"name{i % distinct}" for i in range(values)])
    row = by(profile.profile(df), "attribute")["v"]
    assert ("LOW_UNIQUENESS" in row["anomaly_flags"]) is flagged


@pytest.mark.parametrize("share, flagged", [(50, False), (51, True), (89, True), (90, False)])
def test_pattern_flag_limits(spark, share, flagged):
    values = [f"u{i}@corp.org" for i in range(share)] + [f"user {i}" for i in range(100 - share)]
    row = by(profile.profile(frame(spark, "v", values)), "attribute")["v"]
    assert row["email_pct"] == float(share)
    assert ("PATTERN_INCONSISTENCY" in row["anomaly_flags"]) is flagged


def test_score_terms(spark):
    # 40% nulls: 20 points and a flag; ratio 1.0 adds 5.
    df = frame(spark, "v", [None] * 4 + [f"value{i}" for i in range(6)])
    row = by(profile.profile(df), "attribute")["v"]
    assert row["quality_score"] == 100 - 20 - 10 + 5


def test_thresholds_are_parameters(spark):
    df = frame(spark, "v", ["abc", None])
    assert by(profile.profile(df), "attribute")["v"]["anomaly_flags"] == ["HIGH_NULL_RATE"]
    relaxed = profile.profile(df, limits=Thresholds(high_null_pct=60))
    assert by(relaxed, "attribute")["v"]["anomaly_flags"] == []


def test_boolean_array_and_object_branches(spark):
    df = spark.createDataFrame(
        [(True, [1, 2], {"a": "x"}), (False, [], {"a": "y", "b": "z"}), (None, None, None)],
        "b boolean, l array<int>, m map<string,string>",
    )
    rows = by(profile.profile(df), "attribute")
    assert (rows["b"]["true_count"], rows["b"]["false_count"], rows["b"]["true_percentage"]) == (1, 1, 50.0)
    assert (rows["l"]["min_length"], rows["l"]["max_length"], rows["l"]["empty_arrays"]) == (0, 2, 1)
    assert rows["l"]["avg_length"] == 1.0 and rows["l"]["median_length"] == 1.0
    assert (rows["m"]["unique_keys"], rows["m"]["avg_keys_per_object"], rows["m"]["key_consistency"]) == (2, 1.5, 1.0)


def test_profile_does_not_depend_on_partitioning(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    spread = df.repartition(7, "c_nationkey")
    assert by(profile.profile(df), "attribute") == by(profile.profile(spread), "attribute")


def test_present_plus_null_is_total(spark, sf_dir):
    rows = profile.profile(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert all(r.present_count + r.null_count == r.total_count and 0 <= r.quality_score <= 100 for r in rows)


def test_odd_column_names(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], ["a.b `c`'s", "Größe (€)"])
    assert set(by(profile.profile(df), "attribute")) == {"a.b `c`'s", "Größe (€)"}


def test_many_columns(spark):
    df = spark.range(50).select(*[(F.col("id") * n).alias(f"c{n}") for n in range(1, 31)])
    rows = by(profile.profile(df), "attribute")
    assert len(rows) == 30 and rows["c30"]["max_value"] == 49 * 30


def test_long_texts_count_by_digest(spark):
    long = "x" * 500
    df = frame(spark, "v", [long + "a", long + "b", long + "a", "short"])
    assert by(frequency.distinct_counts(df), "attribute")["v"]["unique_count"] == 3
    assert by(frequency.distinct_counts(df, approximate=True), "attribute")["v"]["unique_count"] == 3


def test_top_values_break_ties_by_first_appearance(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("cbacba")], "o int, v string")
    assert [r.value for r in frequency.top_values(df, ["v"], 2, "o").orderBy("rank").collect()] == ["c", "b"]
    assert [r.value for r in frequency.top_values(df, ["v"], 2).orderBy("rank").collect()] == ["a", "b"]


def test_top_values_limits_before_the_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = frequency.top_values(df, ["l_partkey"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_basic_profile_counts_blank_as_value(spark):
    df = spark.createDataFrame([("", 1.0), ("a", 3.0), (None, None)], "s string, n double")
    rows = by(profile.basic_profile(df), "attribute")
    assert rows["s"]["unique_count"] == 2 and rows["s"]["null_count"] == 1
    assert rows["n"]["std"] == pytest.approx(2**0.5)
    assert rows["n"]["quality_score"] == pytest.approx(100 - 100 / 3)


def test_ties_of_types_go_by_the_row_order(spark):
    df = spark.createDataFrame([(3, "x", "1"), (1, "5", "2.5"), (2, "y", "7"), (4, "6", "8.5")], "i int, a string, b string")
    kinds = lambda **o: {r["attribute"]: r["data_type"] for r in profile.profile(df, **o).collect()}
    assert kinds() == {"i": "integer", "a": "integer", "b": "integer"}
    assert kinds(order_by="i") == {"i": "integer", "a": "integer", "b": "float"}
    back = df.withColumn("back", F.to_timestamp(F.concat(F.lit("2024-01-0"), 5 - F.col("i"))))
    found = {r["attribute"]: r["data_type"] for r in profile.profile(back, order_by="back").collect()}
    assert (found["a"], found["b"]) == ("integer", "float") and found["back"] == "datetime"
