import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from datagauge.functions.dates import is_date_format, parse_date
from datagauge.operators import issues as I
from datagauge.operators import rules

from .conftest import by

TODAY = "2024-12-31"


def fired(spark, schema, *values, **options):
    df = spark.createDataFrame([tuple(values)], schema)
    return [(r.rule, r.message) for r in rules.record_issues(df, TODAY, row_index=F.lit(7), **options).collect()]


def rules_of(spark, schema, *values):
    return {r for r, _ in fired(spark, schema, *values)} - {"V11"}


@pytest.mark.parametrize(
    "text, day",
    [
        ("2023-01-05", "2023-01-05"),
        ("1/2/2023", "2023-01-02"),
        ("13/02/2023", "2023-02-13"),
        ("13-02-2023", "2023-02-13"),
        ("02-13-2023", "2023-02-13"),
        ("2023/1/2", "2023-01-02"),
        ("2023-02-30", None),
        ("2023-01-05T10:00:00+02:00", "2023-01-05"),
        ("2023-01-05 10:00:00", "2023-01-05"),
        ("2023-01-05 25:00:00", None),
        (" 2023-01-05\n", "2023-01-05"),
        ("0000-00-00", None),
        ("invalid-date", None),
        ("", None),
    ],
)
def test_date_parsing(spark, text, day):
    df = spark.createDataFrame([(text,)], "d string")
    found = df.select(parse_date(F.col("d"))).first()[0]
    assert found == (datetime.date.fromisoformat(day) if day else None)


@pytest.mark.parametrize("text, good", [("2023-13-45", True), ("2023/01/01", True), ("01-02-2023", True), ("1/2/2023", False), ("20230101", False)])
def test_date_format(spark, text, good):
    assert spark.createDataFrame([(text,)], "d string").select(is_date_format(F.col("d"))).first()[0] is good


def test_record_fields(spark):
    df = spark.createDataFrame(
        [(None, "7", " Ann ", "x", "41", ["2020-01-01", None], "2021-01-01")],
        "user_id string, id string, name string, Age string, user_age string, purchase_dates array<string>, order_date string",
    )
    row = df.select(
        rules.record_id(df).alias("id"), rules.record_name(df).alias("name"), rules.record_email(df).alias("email"),
        rules.record_age(df).alias("age"), rules.purchase_dates(df).alias("bought"),
    ).first()
    assert tuple(row) == ("7", "Ann", "", 41, ["2020-01-01", "2021-01-01"])


@pytest.mark.parametrize(
    "schema, values, expected",
    [
        ("signup_date string", ("2025-01-01",), {"V02", "V14"}),
        ("signup_date string", ("1970-01-01",), {"V03"}),
        ("signup_date string, order_date string", ("2020-01-01", "2019-01-01"), {"V05"}),
        ("order_date string", ("2030-01-01",), {"V04"}),
        ("name string, email string", ("Bob Lee", "zed@corp.org"), {"V06"}),
        ("name string, email string", ("Bob Lee", "bobby@corp.org"), set()),
        ("age int, signup_date string", (20, "2010-01-01"), {"V07"}),
        ("email string", ("nope",), {"V08", "V18"}),
        ("email string", ("a@example.com",), {"V18"}),
        ("email string", ("a@mytemp.org",), {"V18"}),
        ("email string", ("",), {"V18"}),
        ("age int", (-1,), {"V09", "V26"}),
        ("age int", (151,), {"V09", "V26"}),
        ("age int", (12,), {"V09", "V26"}),
        ("salary double", (None,), {"V10"}),
        ("salary string", ("much",), {"V10"}),
        ("salary double", (20000.0,), set()),
        ("salary double", (2e6,), {"V10", "V26"}),
        ("hire_date string", ("n/a",), {"V13"}),
        ("hire_date string", ("5 May 2020",), {"V13"}),
        ("birth_date string", ("1890-01-01",), {"V15"}),
        ("start_date string, end_date string", ("2020-02-01", "2020-01-01"), {"V16"}),
        ("birth_date date, hire_date date", (datetime.date(2000, 1, 1), datetime.date(1999, 1, 1)), {"V16"}),
        ("customer_id string", (None,), {"V19"}),
        ("customer_id string", (" ",), {"V19", "V24"}),
        ("customer_id string", ("undefined",), {"V24"}),
        ("order_id string", ("x" * 51,), {"V24"}),
        ("is_active string", ("maybe",), {"V20"}),
        ("is_active string", ("Yes",), set()),
        ("is_active boolean", (True,), set()),
        ("years_experience int", (71,), {"V21", "V26"}),
        ("hours_worked double", (169.0,), {"V21"}),
        ("budget string", ("lots",), {"V21"}),
        ("tax_rate double", (100.5,), {"V22"}),
        ("tax_rate string", ("ten",), {"V22"}),
        ("phone string", ("+1 (555) 010-0199",), set()),
        ("phone string", ("12-34",), {"V23"}),
        ("phone string, phone_number string", ("", "call me"), {"V23"}),
        ("status string", ("active",), {"V25"}),
        ("status string", ("",), set()),
        ("performance_rating double", (5.5,), {"V26"}),
    ],
)
def test_each_rule(spark, schema, values, expected):
    assert rules_of(spark, schema, *values) == expected


@pytest.mark.parametrize(
    "name, expected",
    [("", "V11"), ("Test", "V11"), ("x", "V11"), ("y" * 101, "V11"), ("Ann3", "V12"), ("undefined", "V12"), ("Ann O'Neil-Lee Jr.", None)],
)
def test_names(spark, name, expected):
    found = {r for r, _ in fired(spark, "name string", name)}
    assert found == ({expected} if expected else set())


def test_messages(spark):
    found = dict(fired(spark, "age int, signup_date string, name string", 5, "2024-01-01", "Ann Lee"))
    assert found["V09"] == "BUSINESS RULE VIOLATION: User Record_7 below minimum age requirement: 5"
    assert found["V07"] == "AGE INCONSISTENCY: User Record_7 would have been 4.0 years old at signup (too young)"


def test_each_purchase_date_is_checked(spark):
    found = fired(spark, "name string, purchase_dates array<string>, signup_date string", "Ann", ["2030-01-01", "2019-01-01", "2031-01-01"], "2020-01-01")
    assert sorted(r for r, _ in found) == ["V04", "V04", "V05"]


def test_own_rules_can_be_added(spark):
    def no_zero(k):
        code = k.issue("X01", "ZERO", "business_logic_issues", "LOW", "qty", " has no quantity")
        k.add((F.col("qty") == 0, code))

    df = spark.createDataFrame([("Ann", 0), ("Ann", 1)], "name string, qty int")
    found = rules.record_issues(df, TODAY, rules.RuleSet(extra=(no_zero,)), row_index=F.lit(1)).collect()
    assert [(r.rule, r.message) for r in found] == [("X01", "ZERO: User Record_1 has no quantity")]


@pytest.mark.parametrize(
    "message, category, severity",
    [
        ("IMPOSSIBLE VALUE: User 1 has negative age: -4", "age_inconsistencies", "CRITICAL"),
        ("INVALID ID FORMAT: User 1 has invalid order_id: 'n/a'", "impossible_sequences", "LOW"),
        ("INVALID CATEGORY: User 1 has invalid priority: 'x' (expected: Low, Medium, High, Critical)", "logical_inconsistencies", "CRITICAL"),
        ("INVALID DATE FORMAT: User 1 has invalid hire_date: 'x'", "logical_inconsistencies", "LOW"),
        ("CRITICAL: User 1 has future signup date: 2030-01-01", "future_dates", "CRITICAL"),
        ("MISSING REQUIRED FIELD: User 1 has empty email", "missing_required_fields", "CRITICAL"),
        ("EMAIL FORMAT ERROR: User 1 has invalid email format: 'x'", "email_format_issues", "HIGH"),
        ("INVALID FORMAT: User 1 has non-numeric salary: x", "data_type_violations", "HIGH"),
        ("UNREALISTIC VALUE: User 1 has extremely high salary: 2", "business_logic_issues", "HIGH"),
        ("STATISTICAL ANOMALY: User 1 has unusual salary: 2.0", "statistical_anomalies", "LOW"),
    ],
)
def test_keyword_mode_reads_the_words(spark, message, category, severity):
    df = spark.createDataFrame([(message,)], "message string")
    row = I.by_keyword(df).first()
    assert (row.category, row.severity) == (category, severity)


COUNTS = ("critical_issues", "major_issues", "minor_issues", "business_issues", "impossible_values", "unrealistic_values", "missing_required", "format_issues")


@pytest.mark.parametrize(
    "found, grade, score, ready, risk",
    [
        ({}, "A", 95.0, "Ready", "Low"),
        ({"minor_issues": 1}, "B", 85.0, "Ready", "Low"),
        ({"major_issues": 1}, "C", 75.0, "Needs Review", "Medium"),
        ({"major_issues": 6}, "C", 5.0, "Needs Review", "High"),
        ({"business_issues": 4}, "D", 23.0, "Not Ready", "Low"),
        ({"missing_required": 3}, "D", 50.0, "Not Ready", "Low"),
        ({"critical_issues": 1}, "D", 40.0, "Not Ready", "Critical"),
        ({"critical_issues": 6}, "F", 0.0, "Not Ready", "Critical"),
        ({"impossible_values": 4}, "F", 15.0, "Not Ready", "Low"),
    ],
)
def test_grades(spark, found, grade, score, ready, risk):
    df = spark.createDataFrame([tuple(found.get(c, 0) for c in COUNTS)], ", ".join(f"{c} long" for c in COUNTS))
    row = I.corrected_scores(df, 95.0, 100).first()
    assert (row.quality_grade, row.corrected_score, row.production_readiness, row.risk_level) == (grade, score, ready, risk)


def test_component_and_weighted_scores(spark):
    values = {"major_issues": 2, "business_issues": 1, "missing_required": 3, "format_issues": 1, "impossible_values": 1}
    df = spark.createDataFrame([tuple(values.get(c, 0) for c in COUNTS)], ", ".join(f"{c} long" for c in COUNTS))
    row = I.corrected_scores(df, 95.0, 100).first()
    assert (row.completeness, row.validity, row.consistency, row.business_rule_compliance) == (74.0, 82.0, 72.0, 60.0)
    assert row.weighted_score == round(0.3 * 74 + 0.25 * 82 + 0.25 * 72 + 0.2 * 60, 2)
    assert row.error_rate == 3.0


def test_rates_without_records(spark):
    empty = spark.createDataFrame([], "category string, severity string")
    assert tuple(I.validation_rates(empty, 0).first()) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(I.validation_rates(empty, 5).first()) == (100.0, 100.0, 100.0, 100.0)


def test_violation_table_folds_records(spark):
    df = spark.createDataFrame([("V09", "age", str(i % 5)) for i in range(20)], "rule string, field string, record_id string")
    row = by(I.violation_table(df, 3), "rule")["V09"]
    assert (row["violation_count"], row["affected_records"], row["sample_records"]) == (20, 5, "0,1,2")


def test_ids_and_sums_over_the_table(spark):
    """Null and empty ids are none, a hot id flags each of its rows, missing parts and lines count as zero."""
    rows = [("hot", 3.0, 1.0, 2.0, 0.0)] * 500 + [("a", 5.0, 2.0, 2.0, 9.0), ("b", None, 1.0, 1.0, 4.0), (None, 1.0, None, 1.0, 0.0), (None, 1.0, 1.0, None, 0.0), ("", 2.0, 1.0, 1.0, 0.0), ("", 2.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "ref string, total double, x double, y double, n_lines double")
    lines = spark.createDataFrame([("a", 4.0), ("a", 5.0), ("b", 3.0), ("other", 7.0), (None, 1.0)], "of string, n double")
    declared = rules.RuleSet(unique=("ref", "absent"), sums=(rules.ComponentSum("total", ("x", "y")), rules.LineSum("n_lines", "ref", lines, "of", F.col("n")), rules.ComponentSum("absent", ("x",))))
    found = rules.record_issues(df, "2024-12-31", declared, values=True).where("rule IN ('V27', 'V28')").collect()
    kinds = Counter((r["rule"], r["field"], r["actual"], r["expected"]) for r in found)
    assert kinds == {("V28", "ref", "hot", "a value of its own"): 500, ("V27", "total", "5.0", "4.0"): 1, ("V27", "n_lines", "4.0", "3.0"): 1}
    assert {r["category"] for r in found} == {"business_logic_issues"} and {r["severity"] for r in found} == {"CRITICAL"}
    assert rules.record_issues(df, "2024-12-31").where("rule IN ('V27', 'V28')").count() == 0
    assert I.issue_counts(rules.record_issues(df, "2024-12-31", declared).where("rule IN ('V27', 'V28')")).first()["business_issues"] == 502
    detail = {(r["rule"], r["field"]): r for r in I.violation_details(rules.record_issues(df, "2024-12-31", declared, row_index=F.lit(7), values=True), "t", 2).collect()}
    hot = detail["V28", "ref"]
    assert hot["violation_count"] == 500 and hot["affected_records"] == 1 and hot["current_values"] == ["hot", "hot"] and len(hot["sample_records"]) == 2
    assert detail["V27", "total"]["expected_values"] == ["4.0"]


def test_values_of_issues(spark):
    df = spark.createDataFrame([("1", 200, "Sales?", "2030-01-01")], "id string, age int, department string, signup_date string")
    found = {(r["rule"], r["field"]): (r["actual"], r["expected"]) for r in rules.record_issues(df, "2024-12-31", values=True).collect()}
    assert found["V26", "age"] == ("200", "16 to 100") and found["V25", "department"][0] == "Sales?" and found["V25", "department"][1].startswith("HR, Finance")
    assert found["V02", "signup_date"] == ("2030-01-01", None)
