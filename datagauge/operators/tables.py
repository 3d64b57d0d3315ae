"""Table- and dataset-level results: shape, schema, completeness, duplicates, freshness, scores and issues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datagauge.functions import columns as C
from datagauge.params import DEFAULTS, Thresholds

ISO_START = r"^\d{4}-\d{2}-\d{2}"


def dataset_info(df: DataFrame) -> DataFrame:
    """One row: records, attributes, bytes of the JSON form, and whether any column is nested."""
    nested = any(k in ("array", "object") for k in C.families(df).values())
    row_bytes = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    return df.agg(
        F.count("*").alias("total_records"),
        F.lit(len(df.columns)).alias("total_attributes"),
        F.coalesce(F.sum(row_bytes), F.lit(0)).alias("json_bytes"),
        F.lit(nested).alias("has_nested_objects"),
    )


def key_sets(df: DataFrame, json_column: str) -> DataFrame:
    """``(key_set, n)``: how many JSON objects have each set of keys. A key with a null value counts as present."""
    keys = F.array_sort(F.json_object_keys(C.col(json_column)))
    sets = df.select(F.array_join(keys, "\x1f").alias("joined"), F.size(keys).alias("size"))
    return (
        sets.where("joined is not null")
        .groupBy("joined", "size")
        .agg(F.count("*").alias("n"))
        .select(F.when(F.col("size") == 0, F.array().cast("array<string>")).otherwise(F.split("joined", "\x1f")).alias("key_set"), "n")
    )


def schema_summary(df: DataFrame, json_column: str) -> DataFrame:
    """One row: share of records with the most common key set, number of key sets, and that set."""
    sets = key_sets(df, json_column)
    # max over a struct picks the largest count; ties go to the greatest key set.
    return sets.agg(
        F.sum("n").alias("records"),
        F.count("*").alias("unique_schemas"),
        F.max(F.struct("n", "key_set")).alias("top"),
    ).select(
        C.percent(F.col("top.n"), F.col("records")).alias("schema_consistency"),
        "unique_schemas",
        F.col("top.key_set").alias("most_common_schema_attributes"),
    )


def attribute_presence(df: DataFrame, json_column: str, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Presence rate per key, with the optional and required marks. Works on the grouped key sets, not on rows."""
    sets = key_sets(df, json_column)
    counts = sets.select(F.explode("key_set").alias("attribute"), "n").groupBy("attribute").agg(F.sum("n").alias("n"))
    records = df.where(C.col(json_column).isNotNull()).count()
    return counts.select(
        "attribute",
        F.round(F.col("n") / records * 100, 2).alias("presence_rate"),
        (F.col("n") < records * limits.optional_presence_pct / 100).alias("is_optional"),
        (F.col("n") == records).alias("is_required"),
    )


def filled_fields(df: DataFrame) -> Column:
    """How many columns of a row hold a value."""
    return reduce(lambda a, b: a + b, [F.when(C.present(df, n).isNotNull(), 1).otherwise(0) for n in df.columns])


def record_completeness(df: DataFrame) -> DataFrame:
    """One row: mean, smallest and largest share of filled fields; complete and under-half-filled records."""
    score = filled_fields(df) / F.lit(len(df.columns)) * 100
    return df.select(score.alias("score")).agg(
        F.round(F.avg("score"), 2).alias("avg_completeness"),
        F.round(F.min("score"), 2).alias("min_completeness"),
        F.round(F.max("score"), 2).alias("max_completeness"),
        F.count_if(F.col("score") == 100).alias("records_100_complete"),
        F.count_if(F.col("score") < 50).alias("records_below_50_complete"),
    )


def duplicate_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: duplicates, their share, and distinct records. Rows are compared by their JSON form.

    A count of 64-bit hashes tells which rows may repeat; a hash that occurs once is a record of its own. Only rows
    of the other hashes are grouped by the SHA-256 of their form, and none where no hash repeats.
    """
    names = sorted(columns or df.columns)
    forms = df.select(F.to_json(F.struct(*[C.col(n) for n in names]), {"ignoreNullFields": "false"}).alias("form"))
    hashed = forms.select(F.xxhash64("form").alias("h"), "form")
    counts = hashed.groupBy("h").agg(F.count("*").alias("n"))
    once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("n") == 1).alias("single"))
    repeated = counts.where("n > 1").select("h")
    exact = hashed.join(repeated, "h", "left_semi").select(F.unhex(F.sha2("form", 256)).alias("row_key")).distinct().agg(F.count("*").alias("several"))
    # Two rows, of which one has the single records and the other those that occur more often.
    parts = once.select("total", F.col("single").alias("unique_records")).unionByName(exact.select(F.lit(0).alias("total"), F.col("several").alias("unique_records")))
    both = parts.agg(F.sum("total").alias("total"), F.sum("unique_records").alias("unique_records"))
    return both.select(
        (F.col("total") - F.col("unique_records")).alias("total_duplicates"),
        C.percent(F.col("total") - F.col("unique_records"), F.col("total")).alias("duplicate_percentage"),
        "unique_records",
    )


def date_fields(df: DataFrame) -> list[str]:
    """Date columns: typed ones, and strings that look like dates by name or by any value."""
    kinds = C.families(df)
    strings = [n for n, k in kinds.items() if k == "string"]
    found = [n for n, k in kinds.items() if k == "datetime"]
    if strings:
        looks = df.agg(
            *[
                F.max(
                    C.col(n).isNotNull() & (F.lit("date" in n.lower()) | F.coalesce(C.col(n).rlike(ISO_START), F.lit(False)))
                ).alias(n)
                for n in strings
            ]
        ).first()
        found += [n for n in strings if looks[n]]  # null for an empty table
    return [n for n in df.columns if n in found]


def freshness(df: DataFrame) -> DataFrame:
    """Per date field: earliest and latest value and the days between them, over the whole table."""
    kinds = C.families(df)
    fields = date_fields(df)
    schema = "field string, earliest_date string, latest_date string, date_range_days int"
    if not fields:
        return df.sparkSession.createDataFrame([], schema)
    structs = []
    for n in fields:
        c = C.col(n)
        if kinds[n] == "string":
            value = F.when(c.rlike(ISO_START), c)
        else:
            value = c
        low, high = F.min(value).cast("string"), F.max(value).cast("string")
        structs.append(
            F.struct(F.lit(n).alias("field"), low.alias("earliest_date"), high.alias("latest_date")).alias(n)
        )
    bounds = df.agg(*structs).select(F.inline(F.array(*[C.col(n) for n in fields])))

    def day(c: str) -> Column:
        return F.substring(c, 1, 10).try_cast("date")

    days = F.date_diff(day("latest_date"), day("earliest_date"))
    return bounds.where("earliest_date is not null").withColumn("date_range_days", F.coalesce(days, F.lit(0)))


def table_scores(profiles: DataFrame) -> DataFrame:
    """Per table: attributes, score, flags, affected attributes and anomaly rate, from profile rows."""
    n = F.col("total_attributes")
    adjusted = F.col("base") + F.when(n.between(5, 20), 5).when(n > 50, -5).otherwise(0)
    return (
        profiles.groupBy("table_name")
        .agg(
            F.count("*").alias("total_attributes"),
            F.max("total_count").alias("total_records"),
            F.avg("quality_score").alias("base"),
            F.sum(F.size("anomaly_flags")).alias("total_anomalies"),
            F.count_if(F.size("anomaly_flags") > 0).alias("affected_attributes"),
        )
        .select(
            "table_name",
            "total_records",
            "total_attributes",
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(adjusted, 2))).alias("data_quality_score"),
            "total_anomalies",
            "affected_attributes",
            C.percent(F.col("affected_attributes"), n).alias("anomaly_rate"),
        )
    )


def anomaly_types(profiles: DataFrame) -> DataFrame:
    """``(table_name, flag, n)``."""
    flags = profiles.select("table_name", F.explode("anomaly_flags").alias("flag"))
    return flags.groupBy("table_name", "flag").agg(F.count("*").alias("n"))


def attribute_issues(profiles: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """``(table_name, issue)``: the issue texts of every attribute."""
    name = F.col("attribute")

    def says(template: str, *args: Column) -> Column:
        return F.format_string("'%s' has " + template, name, *args)

    nulls = F.col("null_percentage")
    fixed = F.array(
        F.when(nulls > limits.very_high_null_pct, says("very high null rate (%.1f%%)", nulls)).when(
            nulls > limits.high_null_pct, says("high null rate (%.1f%%)", nulls)
        ),
        F.when(F.col("quality_score") < 50, says("low quality score (%.1f/100)", F.col("quality_score"))),
    )

    def flag_text(flag: Column) -> Column:
        plain = F.lower(F.replace(flag, F.lit("_"), F.lit(" ")))
        return (
            F.when(flag == "HIGH_NULL_RATE", F.lit(None))
            .when(flag == "NUMERIC_OUTLIERS_DETECTED", says("%d numeric outliers", F.col("outlier_count")))
            .when(flag == "PATTERN_INCONSISTENCY", says("inconsistent data patterns"))
            .when(flag == "LOW_UNIQUENESS", says("low uniqueness (%.2f)", F.col("unique_ratio")))
            .otherwise(F.concat(F.lit("'"), name, F.lit("' has "), plain))
        )

    issues = F.array_compact(F.concat(fixed, F.transform("anomaly_flags", flag_text)))
    return profiles.select("table_name", F.explode(issues).alias("issue"))


def top_issues(profiles: DataFrame, per_table: int | None = None, limits: Thresholds = DEFAULTS) -> DataFrame:
    """The issues of every table, ranked in alphabetical order; the first ``per_table`` of them if given."""
    ranked = Window.partitionBy("table_name").orderBy("issue")
    issues = attribute_issues(profiles, limits).withColumn("rank", F.row_number().over(ranked))
    kept = issues if per_table is None else issues.where(F.col("rank") <= per_table)
    return kept.select("table_name", "rank", "issue")


def dataset_summary(profiles: DataFrame) -> DataFrame:
    """One row over all tables: tables, records, attributes, mean score, flags and affected tables."""
    scores = table_scores(profiles)
    return scores.agg(
        F.count("*").alias("total_tables"),
        F.sum("total_records").alias("total_records"),
        F.sum("total_attributes").alias("total_attributes"),
        F.round(F.avg("data_quality_score"), 2).alias("overall_quality_score"),
        F.sum("total_anomalies").alias("total_anomalies"),
        F.count_if(F.col("total_anomalies") > 0).alias("affected_tables"),
        F.when(F.count("*") > 1, "multi_table").otherwise("single_table").alias("dataset_type"),
    )


def global_anomalies(profiles: DataFrame) -> DataFrame:
    """``(flag, n, affected_tables)`` over all tables."""
    return anomaly_types(profiles).groupBy("flag").agg(
        F.sum("n").alias("n"), F.count_distinct("table_name").alias("affected_tables")
    )


def critical_issues(
    profiles: DataFrame, positions: DataFrame, limit: int | None = None, per_table: int | None = None
) -> DataFrame:
    """The issues of the dataset: tables in their given order, each with its (first) issues; limits are optional.

    ``positions`` is ``(table_name, position)``; both frames hold a few rows per table.
    """
    issues = top_issues(profiles, per_table).join(F.broadcast(positions), "table_name")
    ordered = issues.orderBy("position", "rank")
    return (ordered if limit is None else ordered.limit(limit)).select("table_name", "rank", "issue")
