"""Report tables from profile rows: column report, six-metric scorecard and its rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datagauge.functions import columns as C
from datagauge.operators.ordering import with_running_totals

# Type names of the report, and the metrics of the scorecard.
REPORT_TYPES = {
    "string": "VARCHAR", "numeric": "DECIMAL", "float": "DECIMAL", "int": "INTEGER",
    "datetime": "TIMESTAMP", "bool": "BOOLEAN",
}
TIMELINESS = 95.0


def report_type(data_type: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in REPORT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(data_type)), F.upper(data_type))


def string_labels(df: DataFrame) -> DataFrame:
    """``(attribute, label)``: the shape that all values of a string column have; one scan for all columns."""
    names = [n for n, k in C.families(df).items() if k == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "attribute string, label string")

    def shape(n: str) -> Column:
        v = C.col(n)
        return F.struct(
            F.lit(n).alias("attribute"),
            F.count(v).alias("n"),
            F.bool_and(v.contains("@")).alias("email"),
            F.bool_and(v.startswith("http")).alias("url"),
            F.bool_and(F.regexp_replace(v, "[- ]", "").rlike(r"^[\p{L}\p{N}]+\z")).alias("alnum"),
        )

    tests = df.agg(F.array(*[shape(n) for n in names]).alias("shapes")).select(F.inline("shapes")).where("n > 0")
    label = (
        F.when(F.col("email"), "Email format")
        .when(F.col("url"), "URL format")
        .when(F.col("alnum"), "Alphanumeric")
        .otherwise("Free text")
    )
    return tests.select("attribute", label.alias("label"))


def sequential_columns(df: DataFrame, order_by: Sequence[str]) -> list[str]:
    """Whole-number columns that rise by one from row to row.

    One aggregate rules out every column whose range does not fit its count; only what is left needs the row order.
    """
    names = [n for n, k in C.families(df).items() if k == "integer"]
    if not names:
        return []
    shape = df.agg(
        *[F.struct(F.min(C.col(n)).alias("low"), F.max(C.col(n)).alias("high"), F.count(C.col(n)).alias("n")).alias(n) for n in names]
    ).first()
    possible = [n for n in names if shape[n].n and shape[n].high - shape[n].low == shape[n].n - 1]
    if not possible:
        return []
    # One order for all of them; a position counts the rows up to it that have a value.
    order = list(dict.fromkeys([*order_by, *possible]))
    rows = df.select(*[C.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    plain = {n: f"c{order.index(n)}" for n in possible}
    placed = with_running_totals(rows, [f"c{i}" for i in range(len(order))], {f"{c}#at": F.col(c).isNotNull().cast("bigint") for c in plain.values()})
    steps = {n: F.when(F.col(c).isNotNull(), F.col(c) - F.col(f"{c}#at")) for n, c in plain.items()}
    ends = placed.agg(*[F.struct(F.min(x).alias("low"), F.max(x).alias("high")).alias(plain[n]) for n, x in steps.items()]).first()
    return [n for n in possible if ends[plain[n]].low == ends[plain[n]].high]


def email_domains_differ(df: DataFrame) -> DataFrame:
    """One row ``differ``: whether a column named ``email`` holds more than one domain; no domain counts as one."""
    known = F.get(F.split(C.col("email"), "@"), F.lit(1))
    missing = F.count_if(C.col("email").isNotNull() & known.isNull()) > 0
    differ = (F.min(known) != F.max(known)) | (missing & (F.count(known) > 0))
    return df.agg(F.coalesce(differ, F.lit(False)).alias("differ"))


def column_report(
    df: DataFrame, profile: DataFrame, order_by: Sequence[str], mode: str = "structured"
) -> DataFrame:
    """One row per column: type, nulls, distinct values, lengths, pattern label, anomalies and issues.

    ``keyword`` mode knows only nulls and "Minor issues", ``structured`` names format and outlier issues too.
    """
    sequential = sequential_columns(df, order_by)
    labels = string_labels(df)
    spread = "email" in df.columns and C.families(df)["email"] == "string" and email_domains_differ(df).first().differ
    kind = report_type(F.col("data_type"))
    number = F.when(F.col("attribute").isin(*sequential), "Sequential") if sequential else F.when(F.lit(False), "")
    pattern = (
        F.when(F.col("present_count") == 0, "")
        .when(kind == "VARCHAR", F.coalesce("label", F.lit("Free text")))
        .when(kind == "INTEGER", number.otherwise("Numeric"))
        .when(kind == "DECIMAL", "Currency")
        .when(kind.isin("DATE", "TIMESTAMP"), "ISO 8601")
        .when(kind == "BOOLEAN", "Boolean")
        .when(F.col("unique_count") <= 10, "Fixed values")
        .otherwise("Variable")
    )
    flags, n_flags = F.col("anomaly_flags"), F.size("anomaly_flags")
    more = F.when(n_flags > 2, F.format_string(" (+%d more)", n_flags - 2)).otherwise("")
    detected = F.when(n_flags > 0, F.concat(F.array_join(F.slice(flags, 1, 2), ", "), more)).otherwise("None")
    missing = F.format_string("%.0f%% missing data", F.col("null_count") / F.col("total_count") * 100)
    issues = F.when(n_flags == 0, "Good")
    if mode == "structured":
        issues = issues.when(F.array_contains(flags, "NUMERIC_OUTLIERS_DETECTED"), "Statistical outliers")
        issues = issues.when(F.array_contains(flags, "PATTERN_INCONSISTENCY"), "Format inconsistency")
    issues = issues.when(F.col("null_count") > 0, missing).otherwise("Minor issues")
    days = F.date_diff(F.to_date("max_date"), F.to_date("min_date"))
    # Taken literally, the range is told of columns reported as DATE alone.
    dated = kind.isin("DATE", "TIMESTAMP") if mode == "structured" else kind == "DATE"
    long_range = dated & (days > 365)
    is_spread = (F.col("attribute") == "email") & F.lit(bool(spread))
    # One row per column on both sides.
    return profile.join(F.broadcast(labels), "attribute", "left").select(
        F.col("attribute").alias("Column"),
        kind.alias("Data_Type"),
        F.col("null_count").alias("Null_Count"),
        F.col("unique_count").alias("Unique_Values"),
        F.when(kind == "VARCHAR", F.col("min_length")).alias("Min_Length"),
        F.when(kind == "VARCHAR", F.col("max_length")).alias("Max_Length"),
        pattern.alias("Pattern"),
        F.when(is_spread, "Different domains (personal vs corporate)")
        .when(long_range, F.format_string("%d-year range", F.floor(days / 365)))
        .otherwise(detected)
        .alias("Anomalies_Detected"),
        F.when(is_spread, "Minor inconsistency")
        .when(long_range, "Expected variation")
        .otherwise(issues)
        .alias("Data_Quality_Issues"),
    )


def scorecard(profiles: DataFrame, invalid_fields: DataFrame | None = None, mode: str = "structured") -> DataFrame:
    """Per table the six scores and their mean, with the counts behind them.

    ``structured``: pattern inconsistency lowers consistency, and the fields of ``invalid_fields``
    (``table_name, attribute``) lower validity. ``keyword``: both stay at 100.
    """
    flag = "PATTERN_INCONSISTENCY"
    inconsistent = F.array_contains("anomaly_flags", flag) if mode == "structured" else F.lit(False)
    rows = profiles
    if mode == "structured" and invalid_fields is not None:
        marked = invalid_fields.select("table_name", "attribute").distinct().withColumn("invalid", F.lit(True))
        rows = rows.join(F.broadcast(marked), ["table_name", "attribute"], "left")  # fields, bounded by the schema
    else:
        rows = rows.withColumn("invalid", F.lit(None).cast("boolean"))
    repeated_id = F.lower("attribute").contains("id") & (F.col("total_count") != F.col("unique_count"))
    counts = rows.groupBy("table_name").agg(
        F.count("*").alias("attributes"),
        F.sum("total_count").alias("cells"),
        F.sum("null_count").alias("missing_cells"),
        F.count_if(inconsistent).alias("format_issues"),
        F.sum(F.size("anomaly_flags")).alias("accuracy_issues"),
        F.count_if(F.coalesce("invalid", F.lit(False))).alias("validity_issues"),
        F.count_if(repeated_id).alias("uniqueness_issues"),
    )
    c = F.col

    def share(found: str, whole: str) -> Column:
        return F.coalesce(C.ratio(c(whole) - c(found), c(whole)) * 100, F.lit(0.0))

    scores = {
        "completeness": share("missing_cells", "cells"),
        "consistency": share("format_issues", "attributes"),
        "accuracy": F.greatest(F.lit(100.0) - c("accuracy_issues") * 5, F.lit(0.0)),
        "validity": share("validity_issues", "attributes"),
        "uniqueness": F.when(c("uniqueness_issues") == 0, 100.0).otherwise(90.0),
        "timeliness": F.lit(TIMELINESS),
    }
    scored = counts.select("*", *[v.alias(k) for k, v in scores.items()])
    mean = reduce(lambda a, b: a + b, [c(k) for k in scores]) / len(scores)
    return scored.withColumn("overall_quality", mean)


def scorecard_rows(scores: DataFrame) -> DataFrame:
    """Seven rows per table: metric, score text, details and recommendation."""
    c = F.col

    def details(name: str, good: float, text: str, count: str, other: str) -> Column:
        said = F.concat(c(count).cast("string"), F.lit(" " + other))
        return F.when(c(name) >= good, text).otherwise(said)

    def advice(name: str, limit: float, good: str, other: str) -> Column:
        return F.when(c(name) >= limit, good).otherwise(other)

    overall = c("overall_quality")
    table = (
        ("Completeness", "completeness", details("completeness", 100, "No null values", "missing_cells", "missing values"),
         advice("completeness", 95, "Maintain current standards", "Improve data collection processes")),
        ("Consistency", "consistency", details("consistency", 100, "All formats consistent", "format_issues", "format inconsistencies"),
         advice("consistency", 90, "Good", "Standardize data formats")),
        ("Accuracy", "accuracy", details("accuracy", 95, "Data appears accurate", "accuracy_issues", "potential accuracy issues"),
         advice("accuracy", 90, "Good", "Review and validate data accuracy")),
        ("Validity", "validity", details("validity", 100, "All formats valid", "validity_issues", "format violations"),
         advice("validity", 95, "Good", "Fix invalid data formats")),
        ("Uniqueness", "uniqueness", details("uniqueness", 100, "All IDs unique", "uniqueness_issues", "duplicate ID issues"),
         advice("uniqueness", 95, "Good", "Ensure ID uniqueness")),
        ("Timeliness", "timeliness", advice("timeliness", 90, "Recent data", "Some outdated records"),
         advice("timeliness", 90, "Good", "Update data more frequently")),
        ("Overall Quality", "overall_quality",
         F.when(overall >= 90, "High quality dataset").when(overall >= 70, "Good quality with room for improvement").otherwise("Needs significant improvement"),
         F.when(overall >= 90, "Minor improvements possible").when(overall >= 70, "Focus on key quality issues").otherwise("Comprehensive quality improvement needed")),
    )
    rows = [
        F.struct(
            F.lit(n).alias("position"),
            F.lit(metric).alias("Metric"),
            F.format_string("%.1f%%", c(name)).alias("Score"),
            said.alias("Details"),
            recommended.alias("Recommendation"),
        )
        for n, (metric, name, said, recommended) in enumerate(table)
    ]
    return scores.select("table_name", F.inline(F.array(*rows)))


def critical_rows(violations: DataFrame, limit: int | None = None) -> DataFrame:
    """Scorecard rows of the rules, worst first, with their whole texts; the first ``limit`` of them if given.

    ``violations``: ``(table_name, issue, severity, description, fix, n)``; ranked per table by count.
    """
    ranked = Window.partitionBy("table_name").orderBy(F.col("n").desc(), "issue")
    first = violations.withColumn("rank", F.row_number().over(ranked))
    if limit is not None:
        first = first.where(F.col("rank") <= limit)
    return first.select(
        "table_name",
        (F.col("rank") + 6).alias("position"),
        F.concat(F.lit("Critical Issue: "), "issue").alias("Metric"),
        F.when(F.col("severity") == "CRITICAL", "CRITICAL").otherwise("HIGH").alias("Score"),
        F.col("description").alias("Details"),
        F.col("fix").alias("Recommendation"),
    )
