"""Checks of the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from datagauge.operators import rules
from datagauge.operators.profile import profile, profile_all
from datagauge.plans import reports

from .profile_checks import COLUMNS, FLAGGED, SCORED, facts_sql
from .registry import ORDERS_WITH_NULLS, PEOPLE, check, derived, table, tables, union_all
from .rule_checks import AS_OF, ISSUES

ALL_COLUMNS = {
    **COLUMNS,
    "events": {
        "event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string", "value": "float",
        "props": "string",
    },
    "labels": {"doc_id": "integer", "quality": "integer", "toxic": "integer"},
}

LABELLED = {
    "documents": ("doc_id", ("text", "lang", "source")), "pages": ("page_id", ("url", "html")),
    "customer": ("c_custkey", ("c_name", "c_mktsegment")), "events": ("event_id", ("event_type", "props")),
}


def label_sql(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS attribute, CASE WHEN bool_and(contains({column}, '@')) THEN 'Email format'
  WHEN bool_and(starts_with({column}, 'http')) THEN 'URL format'
  WHEN bool_and(regexp_full_match(regexp_replace({column}, '[- ]', '', 'g'), '[\\p{{L}}\\p{{N}}]+')) THEN 'Alphanumeric'
  ELSE 'Free text' END AS label
FROM {source} WHERE {column} IS NOT NULL HAVING count(*) > 0"""


@check("report_string_labels", union_all([label_sql(t, c) for t, (_, cs) in LABELLED.items() for c in cs]))
def report_string_labels(spark, sf_dir):
    result = None
    for name in LABELLED:
        part = reports.string_labels(table(spark, sf_dir, name))
        result = part if result is None else result.unionByName(part)
    return result


ORDERS = {"customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "part": "p_partkey"}


def sequential_sql(source: str, order: str, column: str) -> str:
    return f"""SELECT '{source}' AS table_name, '{column}' AS attribute FROM (
  SELECT {column} - lag({column}) OVER (ORDER BY {order}) AS step FROM {source} WHERE {column} IS NOT NULL)
WHERE step IS NOT NULL HAVING bool_and(step = 1)"""


@check(
    "report_sequential",
    union_all(
        [sequential_sql(t, o, c) for t, o in ORDERS.items() for c, k in ALL_COLUMNS[t].items() if k == "integer"]
    ),
)
def report_sequential(spark, sf_dir):
    rows = [
        (t, c) for t, order in ORDERS.items() for c in reports.sequential_columns(table(spark, sf_dir, t), [order])
    ]
    return spark.createDataFrame(rows, "table_name string, attribute string")


@check("report_email_domains", f"SELECT count(DISTINCT split_part(email, '@', 2)) > 1 AS differ FROM ({PEOPLE})")
def report_email_domains(spark, sf_dir):
    return reports.email_domains_differ(derived(spark, sf_dir, PEOPLE))


REPORT_TYPES = {"integer": "INTEGER", "float": "DECIMAL", "string": "VARCHAR", "datetime": "TIMESTAMP"}


def report_sql(source: str, name: str, order: str, columns: dict[str, str], mode: str) -> str:
    facts = union_all([facts_sql(source, c, k, name) for c, k in columns.items()])
    shapes = []
    for c, k in columns.items():
        if k == "string":
            pattern = f"(SELECT label FROM ({label_sql(source, c)}))"
            low, high = f"(SELECT min(length(nullif({c}, ''))) FROM {source})", f"(SELECT max(length(nullif({c}, ''))) FROM {source})"
        else:
            low = high = "NULL"
            pattern = {"integer": "'Numeric'", "float": "'Currency'", "datetime": "'ISO 8601'"}[k]
            if k == "integer":
                pattern = f"CASE WHEN (SELECT count(*) FROM ({sequential_sql(source, order, c)})) > 0 THEN 'Sequential' ELSE 'Numeric' END"
        ranged = k == "datetime" and mode == "structured"
        days = f"(SELECT date_diff('day', min({c}), max({c})) FROM {source})" if ranged else "NULL"
        shapes.append(
            f"SELECT '{c}' AS attribute, '{REPORT_TYPES[k]}' AS t, {low} AS lo, {high} AS hi, {pattern} AS pattern, CAST({days} AS BIGINT) AS days, "
            f"(SELECT count(DISTINCT {f'''nullif({c}, '')''' if k == 'string' else c}) FROM {source}) AS uniq"
        )
    named = ""
    if mode == "structured":
        named = "WHEN contains(flags, 'NUMERIC_OUTLIERS') THEN 'Statistical outliers' WHEN contains(flags, 'PATTERN_INCON') THEN 'Format inconsistency'"
    parts = "string_split(flags, ',')"
    return f"""SELECT attribute AS "Column", t AS "Data_Type", total - present AS "Null_Count", uniq AS "Unique_Values", lo::BIGINT AS "Min_Length", hi::BIGINT AS "Max_Length",
  pattern AS "Pattern", CASE WHEN days > 365 THEN concat(days // 365, '-year range') WHEN flags = '' THEN 'None'
    ELSE concat(array_to_string({parts}[1:2], ', '), CASE WHEN len({parts}) > 2 THEN concat(' (+', len({parts}) - 2, ' more)') ELSE '' END) END AS "Anomalies_Detected",
  CASE WHEN days > 365 THEN 'Expected variation' WHEN flags = '' THEN 'Good' {named}
    WHEN total > present THEN concat(printf('%.0f', (total - present) * 100.0 / total), '% missing data') ELSE 'Minor issues' END AS "Data_Quality_Issues"
FROM ({FLAGGED} FROM ({facts})) JOIN ({union_all(shapes)}) USING (attribute)"""


def _report(spark, sf_dir, name: str, order: str, mode: str):
    df = table(spark, sf_dir, name)
    return reports.column_report(df, profile(df, name), [order], mode)


for _name in ("customer", "orders", "events"):
    for _mode in ("structured", "keyword"):
        check(
            f"report_columns_{_name}" + ("_keyword" if _mode == "keyword" else ""),
            report_sql(_name, _name, ORDERS[_name], ALL_COLUMNS[_name], _mode),
        )(lambda spark, sf_dir, n=_name, m=_mode: _report(spark, sf_dir, n, ORDERS[n], m))


@check(
    "report_columns_email",
    """SELECT 'email' AS "Column", 'Different domains (personal vs corporate)' AS "Anomalies_Detected", 'Minor inconsistency' AS "Data_Quality_Issues" """,
)
def report_columns_email(spark, sf_dir):
    df = derived(spark, sf_dir, PEOPLE).select("customer_id", "email", "age")
    report = reports.column_report(df, profile(df, "people"), ["customer_id"])
    return report.where(F.col("Column") == "email").select("Column", "Anomalies_Detected", "Data_Quality_Issues")


@check(
    "report_columns_nulls",
    report_sql(
        f"({ORDERS_WITH_NULLS})", "v", "o_orderkey",
        {"customer_id": "integer", "o_orderstatus": "string", "o_totalprice": "float"}, "structured",
    ),
)
def report_columns_nulls(spark, sf_dir):
    df = derived(spark, sf_dir, ORDERS_WITH_NULLS)
    kept = df.select("customer_id", "o_orderstatus", "o_totalprice")
    report = reports.column_report(df, profile(kept), ["o_orderkey"])
    return report


CARDS = ("customer", "orders", "events", "labels")


def scorecard_sql(names: tuple[str, ...], mode: str) -> str:
    facts = union_all([facts_sql(t, c, k) for t in names for c, k in ALL_COLUMNS[t].items()])
    uniq = union_all(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS attribute, count(DISTINCT {c}) AS u FROM {t}"
            for t in names
            for c in ALL_COLUMNS[t]
        ]
    )
    inconsistent = "count(*) FILTER (WHERE contains(flags, 'PATTERN_INCONSISTENCY'))" if mode == "structured" else "0"
    return f"""SELECT *, (completeness + consistency + accuracy + validity + uniqueness + timeliness) / 6 AS overall_quality FROM (
  SELECT table_name, count(*) AS attributes, sum(total)::BIGINT AS cells, sum(total - present)::BIGINT AS missing_cells, {inconsistent} AS format_issues,
    sum(n_flags)::BIGINT AS accuracy_issues, 0::BIGINT AS validity_issues, count(*) FILTER (WHERE contains(lower(attribute), 'id') AND total <> u) AS uniqueness_issues,
    (sum(total) - sum(total - present)) * 100.0 / sum(total) AS completeness, (count(*) - {inconsistent}) * 100.0 / count(*) AS consistency,
    greatest(100 - sum(n_flags) * 5, 0)::DOUBLE AS accuracy, 100.0::DOUBLE AS validity,
    CASE WHEN count(*) FILTER (WHERE contains(lower(attribute), 'id') AND total <> u) = 0 THEN 100.0 ELSE 90.0 END::DOUBLE AS uniqueness, 95.0::DOUBLE AS timeliness
  FROM ({SCORED} FROM ({FLAGGED} FROM ({facts}))) JOIN ({uniq}) USING (table_name, attribute) GROUP BY table_name)"""


SCORE_COLUMNS = ("completeness", "consistency", "accuracy", "validity", "uniqueness", "timeliness", "overall_quality")


def _rounded_card(sql: str) -> str:
    named = ", ".join(f"round({c}, 4)::DOUBLE AS {c}" for c in SCORE_COLUMNS)
    return f"""SELECT table_name, attributes, cells, missing_cells, format_issues, accuracy_issues, validity_issues,
  uniqueness_issues, {named} FROM ({sql})"""


@check("report_scorecard", _rounded_card(scorecard_sql(CARDS, "structured")))
def report_scorecard(spark, sf_dir):
    found = reports.scorecard(profile_all(tables(spark, sf_dir, *CARDS)))
    return found.withColumns({c: F.round(c, 4) for c in SCORE_COLUMNS})


@check("report_scorecard_keyword", _rounded_card(scorecard_sql(CARDS, "keyword")))
def report_scorecard_keyword(spark, sf_dir):
    found = reports.scorecard(profile_all(tables(spark, sf_dir, *CARDS)), mode="keyword")
    return found.withColumns({c: F.round(c, 4) for c in SCORE_COLUMNS})


def _row(position, metric, score, details, advice):
    return (
        f"SELECT table_name, {position} AS position, '{metric}' AS \"Metric\", concat(printf('%.1f', {score}), '%') AS \"Score\", "
        f"{details} AS \"Details\", {advice} AS \"Recommendation\" FROM cards"
    )


def _found(score, good, text, count, other):
    return f"CASE WHEN {score} >= {good} THEN '{text}' ELSE concat({count}, ' {other}') END"


def _advice(score, limit, good, other):
    return f"CASE WHEN {score} >= {limit} THEN '{good}' ELSE '{other}' END"


ROWS = union_all(
    [
        _row(0, "Completeness", "completeness", _found("completeness", 100, "No null values", "missing_cells", "missing values"), _advice("completeness", 95, "Maintain current standards", "Improve data collection processes")),
        _row(1, "Consistency", "consistency", _found("consistency", 100, "All formats consistent", "format_issues", "format inconsistencies"), _advice("consistency", 90, "Good", "Standardize data formats")),
        _row(2, "Accuracy", "accuracy", _found("accuracy", 95, "Data appears accurate", "accuracy_issues", "potential accuracy issues"), _advice("accuracy", 90, "Good", "Review and validate data accuracy")),
        _row(3, "Validity", "validity", _found("validity", 100, "All formats valid", "validity_issues", "format violations"), _advice("validity", 95, "Good", "Fix invalid data formats")),
        _row(4, "Uniqueness", "uniqueness", _found("uniqueness", 100, "All IDs unique", "uniqueness_issues", "duplicate ID issues"), _advice("uniqueness", 95, "Good", "Ensure ID uniqueness")),
        _row(5, "Timeliness", "timeliness", "'Recent data'", "'Good'"),
        _row(
            6, "Overall Quality", "overall_quality",
            "CASE WHEN overall_quality >= 90 THEN 'High quality dataset' WHEN overall_quality >= 70 THEN 'Good quality with room for improvement' ELSE 'Needs significant improvement' END",
            "CASE WHEN overall_quality >= 90 THEN 'Minor improvements possible' WHEN overall_quality >= 70 THEN 'Focus on key quality issues' ELSE 'Comprehensive quality improvement needed' END",
        ),
    ]
)


@check("report_scorecard_rows", f"WITH cards AS ({scorecard_sql(CARDS, 'structured')}) {ROWS}")
def report_scorecard_rows(spark, sf_dir):
    return reports.scorecard_rows(reports.scorecard(profile_all(tables(spark, sf_dir, *CARDS))))


@check(
    "report_scorecard_validity",
    f"""SELECT 'people' AS table_name, count(DISTINCT field) AS validity_issues,
  round((8 - count(DISTINCT field)) * 100.0 / 8, 4) AS validity
FROM ({ISSUES}) WHERE category IN ('data_type_violations', 'email_format_issues')""",
)
def report_scorecard_validity(spark, sf_dir):
    people = derived(spark, sf_dir, PEOPLE)
    issues = rules.record_issues(people, AS_OF, row_index=F.col("customer_id"))
    invalid = issues.where(F.col("category").isin("data_type_violations", "email_format_issues")).select(
        F.lit("people").alias("table_name"), F.col("field").alias("attribute")
    )
    columns = ("customer_id", "name", "email", "age", "signup_date", "is_active", "phone", "department")
    found = reports.scorecard(profile(people.select(*columns), "people"), invalid)
    return found.select("table_name", "validity_issues", F.round("validity", 4).alias("validity"))


@check(
    "report_critical_rows",
    f"""SELECT 'people' AS table_name, CAST(row_number() OVER (ORDER BY n DESC, issue) + 6 AS INTEGER) AS position, concat('Critical Issue: ', issue) AS "Metric",
  CASE WHEN severity = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END AS "Score", concat(n, ' records: ', issue) AS "Details", 'Review and resolve' AS "Recommendation"
FROM (SELECT concat(kind, ' in field ', field) AS issue, severity, count(*) AS n FROM ({ISSUES}) GROUP BY 1, 2)""",
)
def report_critical_rows(spark, sf_dir):
    issues = rules.record_issues(derived(spark, sf_dir, PEOPLE), AS_OF, row_index=F.col("customer_id"))
    grouped = issues.groupBy(F.concat("kind", F.lit(" in field "), "field").alias("issue"), "severity").agg(
        F.count("*").alias("n")
    )
    described = grouped.select(
        F.lit("people").alias("table_name"), "issue", "severity", "n",
        F.concat(F.col("n").cast("string"), F.lit(" records: "), "issue").alias("description"),
        F.lit("Review and resolve").alias("fix"),
    )
    return reports.critical_rows(described)
