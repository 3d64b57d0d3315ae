"""Issue classes, rates and quality scores from issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datagauge.functions import columns as C

# The issue categories and severities.
CATEGORIES = (
    "temporal_issues", "cross_field_issues", "logical_inconsistencies", "future_dates", "age_inconsistencies",
    "email_format_issues", "impossible_sequences", "business_logic_issues", "missing_required_fields",
    "data_type_violations", "referential_integrity_issues", "statistical_anomalies",
)
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

# The scoring weights of the component scores, in percent.
COMPONENT_WEIGHTS = {"completeness": 30, "validity": 25, "consistency": 25, "business_rule_compliance": 20}


def keyword_category(message: Column) -> Column:
    """Category read off the words of a message; the first test that holds decides."""
    m = F.lower(message)
    has = m.contains
    return (
        F.when(has("future"), "future_dates")
        .when(has("missing required field") | has("empty"), "missing_required_fields")
        .when(has("email") & (has("mismatch") | has("name")), "cross_field_issues")
        .when(has("email") & has("format"), "email_format_issues")
        .when(has("invalid format") | has("non-numeric"), "data_type_violations")
        .when(has("age"), "age_inconsistencies")
        .when(has("sequence") | has("order"), "impossible_sequences")
        .when(has("impossible value") | has("unrealistic value"), "business_logic_issues")
        .when(has("statistical") | has("outlier"), "statistical_anomalies")
        .otherwise("logical_inconsistencies")
    )


def keyword_severity(message: Column) -> Column:
    """Severity read off the words of a message."""
    m = F.lower(message)
    return (
        F.when(m.rlike("critical|missing required field|impossible value|referential integrity"), "CRITICAL")
        .when(m.rlike("invalid format|business logic|unrealistic value|format error"), "HIGH")
        .when(m.rlike("mismatch|inconsistency|outlier"), "MEDIUM")
        .otherwise("LOW")
    )


def by_keyword(issues: DataFrame) -> DataFrame:
    """Issue rows with category and severity read off their messages."""
    return issues.withColumn("category", keyword_category(F.col("message"))).withColumn(
        "severity", keyword_severity(F.col("message"))
    )


def category_counts(issues: DataFrame) -> DataFrame:
    """``(category, n)``; future dates are counted among the temporal issues too."""
    both = F.when(F.col("category") == "future_dates", F.array(F.lit("future_dates"), F.lit("temporal_issues")))
    listed = issues.select(F.explode(both.otherwise(F.array("category"))).alias("category"))
    return listed.groupBy("category").agg(F.count("*").alias("n"))


def severity_counts(issues: DataFrame) -> DataFrame:
    """One row with a count per severity."""
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])


def _in(*categories: str) -> Column:
    return F.count_if(F.col("category").isin(*categories))


def _records(issues: DataFrame, records: int | DataFrame) -> Column:
    return F.lit(records if isinstance(records, int) else records.count()).cast("bigint")


def validation_rates(issues: DataFrame, records: int | DataFrame) -> DataFrame:
    """One row: completeness, validity, consistency and business rates; 0 without records, never under 0."""
    n = _records(issues, records)
    counted = issues.agg(
        _in("missing_required_fields").alias("completeness_rate"),
        _in("data_type_violations", "email_format_issues").alias("validity_rate"),
        _in("cross_field_issues", "age_inconsistencies").alias("consistency_rate"),
        _in("business_logic_issues").alias("business_rule_compliance_rate"),
    )
    rates = [
        F.greatest(F.lit(0.0), F.coalesce(C.ratio(n - F.col(c), n) * 100, F.lit(0.0))).alias(c)
        for c in counted.columns
    ]
    return counted.select(*rates)


def issue_counts(issues: DataFrame, mode: str = "structured") -> DataFrame:
    """One row with the counts the scores are made of.

    In ``keyword`` mode the special kinds are counted only among the business logic issues, where the keyword
    chain never puts missing fields and format errors; in ``structured`` mode every issue of the kind counts.
    """
    business = F.col("category") == "business_logic_issues"

    def kind(name: str) -> Column:
        if mode == "keyword":
            return F.count_if(business & F.col("message").contains(name))
        return F.count_if(F.col("kind") == name)

    return issues.agg(
        _in("future_dates").alias("critical_issues"),
        _in("cross_field_issues", "impossible_sequences").alias("major_issues"),
        _in("age_inconsistencies", "email_format_issues").alias("minor_issues"),
        _in("business_logic_issues").alias("business_issues"),
        kind("IMPOSSIBLE VALUE").alias("impossible_values"),
        kind("UNREALISTIC VALUE").alias("unrealistic_values"),
        kind("MISSING REQUIRED FIELD").alias("missing_required"),
        kind("INVALID FORMAT").alias("format_issues"),
    )


def corrected_scores(counts: DataFrame, original_score: float, records: int, base_completeness: float = 80.0) -> DataFrame:
    """Adds penalty, corrected score, grade, error rate, component and weighted scores, readiness and risk."""
    c = F.col
    penalty = (
        c("critical_issues") * 25 + c("major_issues") * 15 + c("minor_issues") * 8 + c("business_issues") * 18
        + c("impossible_values") * 20 + c("missing_required") * 15
    )
    critical, impossible = c("critical_issues"), c("impossible_values")
    business, major, minor = c("business_issues"), c("major_issues"), c("minor_issues")
    ladder = (
        ((critical > 0) | (impossible > 0), F.when((critical > 5) | (impossible > 3), "F").otherwise("D"), 40),
        ((c("missing_required") > 2) | (business > 5), F.lit("D"), 50),
        ((major > 5) | (business > 2), F.when(business > 3, "D").otherwise("C"), 60),
        ((major > 0) | (minor > 5) | (business > 0), F.lit("C"), 75),
        (minor > 0, F.lit("B"), 85),
    )
    grade, cap = F.when(c("uncapped") >= 90, "A").otherwise("B"), F.lit(100.0)
    for test, letter, limit in reversed(ladder):
        grade = F.when(test, letter).otherwise(grade)
        cap = F.when(test, F.lit(float(limit))).otherwise(cap)
    n = F.lit(max(records, 1))
    total = critical + major + minor + business

    def component(base: float, found: Column, factor: int) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.lit(float(base)) - found / n * 100 * factor), 1)

    scored = (
        counts.withColumn("total_issues", total)
        .withColumn("original_score", F.lit(float(original_score)))
        .withColumn("total_penalty", penalty)
        .withColumn("uncapped", F.greatest(F.lit(0.0), c("original_score") - c("total_penalty")))
        .withColumn("corrected_score", F.least(c("uncapped"), cap))
        .withColumn("quality_grade", grade)
        .withColumn("error_rate", F.round(c("total_issues") / n * 100, 2))
        .withColumn("completeness", component(base_completeness, c("missing_required"), 2))
        .withColumn("validity", component(85, c("format_issues"), 3))
        .withColumn("consistency", component(80, major, 4))
        .withColumn(
            "business_rule_compliance", component(75, business + impossible * 2 + c("unrealistic_values"), 5)
        )
        .drop("uncapped")
    )
    weighted = sum((c(name) * weight for name, weight in COMPONENT_WEIGHTS.items()), F.lit(0.0)) / 100
    ready = (
        F.when(critical > 0, "Not Ready")
        .when(major > 3, "Needs Review")
        .when(c("quality_grade").isin("A", "B"), "Ready")
        .when(c("quality_grade") == "C", "Needs Review")
        .otherwise("Not Ready")
    )
    risk = F.when(critical > 0, "Critical").when(major > 5, "High").when(major > 0, "Medium").otherwise("Low")
    return (
        scored.withColumn("weighted_score", F.round(weighted, 2))
        .withColumn("production_readiness", ready)
        .withColumn("risk_level", risk)
    )


def table_quality(profiles_scores: DataFrame, scored: DataFrame) -> DataFrame:
    """Per table: records, corrected score and the four component rates. ``scored`` carries ``table_name``."""
    kept = scored.select(
        "table_name", "corrected_score", "completeness", "validity", "consistency", "business_rule_compliance",
        "quality_grade",
    )
    # One row per table on both sides.
    return profiles_scores.select("table_name", "total_records").join(F.broadcast(kept), "table_name")


def field_scorecard(profiles: DataFrame, issues: DataFrame) -> DataFrame:
    """Per field: completeness, validity, consistency, rule compliance, uniqueness and the weighted score.

    ``issues`` holds the issue rows of the profiled table; they are counted per field before the join.
    """
    format_kinds = ("data_type_violations", "email_format_issues")
    consistency_kinds = ("cross_field_issues", "impossible_sequences", "age_inconsistencies")
    rule_kinds = ("business_logic_issues", "future_dates", "statistical_anomalies")
    per_field = issues.groupBy(F.col("field").alias("attribute")).agg(
        _in(*format_kinds).alias("format_issues"),
        _in(*consistency_kinds).alias("consistency_issues"),
        _in(*rule_kinds).alias("rule_issues"),
    )
    joined = profiles.join(per_field, "attribute", "left").fillna(
        0, ["format_issues", "consistency_issues", "rule_issues"]
    )
    n = F.col("total_count")

    def rate(found: str) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.coalesce(C.ratio(n - F.col(found), n) * 100, F.lit(0.0))), 2)

    rates = joined.select(
        "table_name",
        "attribute",
        F.round(F.lit(100.0) - F.col("null_percentage"), 2).alias("completeness_rate"),
        rate("format_issues").alias("validity_rate"),
        rate("consistency_issues").alias("consistency_rate"),
        rate("rule_issues").alias("business_rule_compliance"),
        F.round(F.col("unique_ratio") * 100, 2).alias("uniqueness"),
    )
    weights = dict(
        zip(
            ("completeness_rate", "validity_rate", "consistency_rate", "business_rule_compliance"),
            COMPONENT_WEIGHTS.values(),
        )
    )
    score = sum((F.col(name) * w for name, w in weights.items()), F.lit(0.0)) / 100
    return rates.withColumn("quality_score", F.round(score, 2))


def metric_thresholds(df: DataFrame, metrics: dict[str, tuple[Column, float]]) -> DataFrame:
    """Per metric: the share of rows that meet a condition, its limit and pass or fail."""
    rows = [
        F.struct(
            F.lit(name).alias("metric"),
            F.round(F.avg(F.when(test, 100.0).otherwise(0.0)), 4).alias("value"),
            F.lit(float(limit)).alias("threshold"),
        )
        for name, (test, limit) in metrics.items()
    ]
    measured = df.agg(F.array(*rows).alias("metrics")).select(F.inline("metrics"))
    return measured.withColumn("passed", F.col("value") >= F.col("threshold"))


def violation_table(issues: DataFrame, sample_keys: int = 3) -> DataFrame:
    """Per rule and field: issues, affected records, and the first ``sample_keys`` record ids as examples.

    Ids are folded per rule first; the smallest ones come from a rank filter that keeps a few rows per task. The issues
    themselves hold all ids.
    """
    from pyspark.sql import Window

    per_record = issues.groupBy("rule", "field", "record_id").agg(F.count("*").alias("n"))
    totals = per_record.groupBy("rule", "field").agg(
        F.sum("n").alias("violation_count"), F.count("*").alias("affected_records")
    )
    ranked = Window.partitionBy("rule", "field").orderBy("record_id")
    first = (
        per_record.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= sample_keys)
        .groupBy("rule", "field")
        .agg(F.array_join(F.array_sort(F.collect_list("record_id")), ",").alias("sample_records"))
    )
    return totals.join(first, ["rule", "field"])


def violation_details(issues: DataFrame, table_name: str, sample_keys: int = 3) -> DataFrame:
    """Per rule and field of a table: issues, affected records, and of the first ``sample_keys`` issues by record the
    ids, current values and expected values. ``issues`` come from ``record_issues`` with ``values``.

    The filter on the rank keeps a few issues per rule in every task before they are shuffled.
    """
    from pyspark.sql import Window

    keys = ("rule", "kind", "severity", "field")
    totals = issues.groupBy(*keys, "record_id").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("violation_count"), F.count("*").alias("affected_records"))
    order = ("record_id", "actual", "expected")
    ranked = issues.select(*keys, *order).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    sample = ranked.where(F.col("rank") <= sample_keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", *order))).alias("first"))
    listed = [F.col(f"first.{c}").alias(name) for c, name in (("record_id", "sample_records"), ("actual", "current_values"), ("expected", "expected_values"))]
    return totals.join(sample, list(keys)).select(F.lit(table_name).alias("table_name"), *keys, "violation_count", "affected_records", *listed)
