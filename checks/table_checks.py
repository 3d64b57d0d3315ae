"""Checks of table- and dataset-level results."""

from __future__ import annotations

from pyspark.sql import functions as F

from datagauge.operators import tables as T
from datagauge.operators.profile import profile_all
from datagauge.plans.dataset import table_positions

from .profile_checks import scored_sql
from .registry import ORDERS_WITH_NULLS, PEOPLE, STAR, check, derived, table, tables, union_all

SMALL_STAR = ("region", "nation", "customer", "supplier", "part", "orders")


@check(
    "dataset_info",
    union_all(
        [
            f"SELECT '{t}' AS table_name, count(*) AS total_records, {n} AS total_attributes, {nested} AS has_nested_objects FROM {t}"
            for t, n, nested in (("customer", 5, "false"), ("documents", 5, "false"), ("embeddings", 3, "true"), ("lineitem", 11, "false"))
        ]
    ),
)
def dataset_info(spark, sf_dir):
    parts = [
        T.dataset_info(df).select(F.lit(n).alias("table_name"), "total_records", "total_attributes", "has_nested_objects")
        for n, df in tables(spark, sf_dir, "customer", "documents", "embeddings", "lineitem").items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@check(
    "dataset_bytes",
    "SELECT count(*) AS total_records, sum(octet_length(encode(CAST(json_object('role', role, 'text', text, 'turn', turn) AS VARCHAR))))::BIGINT AS json_bytes FROM conversations",
)
def dataset_bytes(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("role", "text", "turn")
    return T.dataset_info(df).select("total_records", "json_bytes")


KEYED = """SELECT event_id, CASE WHEN event_type = 'click' THEN json_object('k', value, 'click', 1)
  WHEN event_type = 'error' THEN json_object('k', value, 'code', NULL) ELSE json_object('k', value) END AS doc FROM events"""


def _keyed(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    keep = {"ignoreNullFields": "false"}
    click = F.to_json(F.struct(F.col("value").alias("k"), F.lit(1).alias("click")))
    error = F.to_json(F.struct(F.col("value").alias("k"), F.lit(None).cast("string").alias("code")), keep)
    plain = F.to_json(F.struct(F.col("value").alias("k")))
    kind = F.col("event_type")
    return df.select("event_id", F.when(kind == "click", click).when(kind == "error", error).otherwise(plain).alias("doc"))


@check(
    "schema_analysis",
    f"""SELECT round(max(n) * 100.0 / sum(n), 2) AS schema_consistency, count(*) AS unique_schemas,
  max_by(keys, n) AS most_common_schema_attributes
FROM (SELECT array_to_string(list_sort(json_keys(doc)), ',') AS keys, count(*) AS n FROM ({KEYED}) GROUP BY 1)""",
)
def schema_analysis(spark, sf_dir):
    found = T.schema_summary(_keyed(spark, sf_dir), "doc")
    return found.withColumn("most_common_schema_attributes", F.array_join("most_common_schema_attributes", ","))


@check(
    "schema_presence",
    f"""SELECT attribute, round(n * 100.0 / t, 2) AS presence_rate, n < t * 0.9 AS is_optional, n = t AS is_required FROM (
  SELECT attribute, count(*) AS n FROM (SELECT unnest(json_keys(doc)) AS attribute FROM ({KEYED})) GROUP BY 1),
  (SELECT count(*) AS t FROM events)""",
)
def schema_presence(spark, sf_dir):
    return T.attribute_presence(_keyed(spark, sf_dir), "doc")


@check(
    "schema_props",
    """SELECT round(max(n) * 100.0 / sum(n), 2) AS schema_consistency, count(*) AS unique_schemas,
  max_by(keys, n) AS most_common_schema_attributes
FROM (SELECT array_to_string(list_sort(json_keys(props)), ',') AS keys, count(*) AS n FROM events GROUP BY 1)""",
)
def schema_props(spark, sf_dir):
    found = T.schema_summary(table(spark, sf_dir, "events"), "props")
    return found.withColumn("most_common_schema_attributes", F.array_join("most_common_schema_attributes", ","))


PEOPLE_STRINGS = ("name", "email", "signup_date", "last_login", "order_date", "is_active", "phone", "department")
PEOPLE_OTHERS = ("customer_id", "age", "salary", "completion_rate")


def completeness_sql(source: str, strings: tuple, others: tuple) -> str:
    filled = " + ".join(
        [f"(CASE WHEN nullif({c}, '') IS NULL THEN 0 ELSE 1 END)" for c in strings]
        + [f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in others]
    )
    n = len(strings) + len(others)
    return f"""SELECT round(avg(score), 2) AS avg_completeness, round(min(score), 2) AS min_completeness,
  round(max(score), 2) AS max_completeness, count(*) FILTER (WHERE score = 100) AS records_100_complete,
  count(*) FILTER (WHERE score < 50) AS records_below_50_complete FROM (SELECT ({filled}) / {n}.0::DOUBLE * 100 AS score FROM {source})"""


@check("completeness_people", completeness_sql(f"({PEOPLE})", PEOPLE_STRINGS, PEOPLE_OTHERS))
def completeness_people(spark, sf_dir):
    return T.record_completeness(derived(spark, sf_dir, PEOPLE))


@check(
    "completeness_orders",
    completeness_sql(f"({ORDERS_WITH_NULLS})", ("o_orderstatus",), ("o_orderkey", "customer_id", "o_totalprice")),
)
def completeness_orders(spark, sf_dir):
    return T.record_completeness(derived(spark, sf_dir, ORDERS_WITH_NULLS))


def duplicates_sql(source: str, columns: str, name: str) -> str:
    return f"""SELECT '{name}' AS table_name, t - u AS total_duplicates, round((t - u) * 100.0 / t, 2) AS duplicate_percentage,
  u AS unique_records FROM (SELECT count(*) AS t FROM {source}), (SELECT count(*) AS u FROM (SELECT DISTINCT {columns} FROM {source}))"""


DUPLICATES = (
    ("documents", "text, lang"), ("conversations", "role, text"), ("lineitem", "l_partkey, l_suppkey, l_quantity"),
    ("events", "user_id, event_type, value, props"), ("customer", "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"),
)


@check("duplicates", union_all([duplicates_sql(t, c, t) for t, c in DUPLICATES]))
def duplicates(spark, sf_dir):
    parts = [
        T.duplicate_summary(table(spark, sf_dir, t), c.split(", ")).select(F.lit(t).alias("table_name"), "*")
        for t, c in DUPLICATES
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def day_range(low: str, high: str) -> str:
    return f"CAST(date_diff('day', CAST({low} AS DATE), CAST({high} AS DATE)) AS INTEGER)"


@check(
    "freshness",
    union_all(
        [
            f"""SELECT '{t}' AS table_name, '{c}' AS field, CAST(CAST(min({c}) AS DATE) AS VARCHAR) AS earliest_day,
  CAST(CAST(max({c}) AS DATE) AS VARCHAR) AS latest_day, {day_range(f"min({c})", f"max({c})")} AS date_range_days FROM {t}"""
            for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
        ]
    ),
)
def freshness(spark, sf_dir):
    parts = []
    for t in ("orders", "lineitem", "events"):
        found = T.freshness(table(spark, sf_dir, t))
        parts.append(
            found.select(
                F.lit(t).alias("table_name"), "field", F.substring("earliest_date", 1, 10).alias("earliest_day"),
                F.substring("latest_date", 1, 10).alias("latest_day"), "date_range_days",
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check(
    "freshness_strings",
    union_all(
        [
            f"""SELECT '{c}' AS field, min({c}) AS earliest_date, max({c}) AS latest_date,
  {day_range(f"min({c})", f"max({c})")} AS date_range_days FROM ({PEOPLE}) WHERE regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')"""
            for c in ("signup_date", "last_login")
        ]
    ),
)
def freshness_strings(spark, sf_dir):
    return T.freshness(derived(spark, sf_dir, PEOPLE))


# Nulls first, dates only in the second half of the rows.
LATE_DATES = """SELECT event_id, CASE WHEN event_id >= (SELECT max(event_id) / 2 FROM events) THEN CAST(CAST(ts AS date) AS varchar(10)) END AS seen FROM events"""


@check(
    "freshness_late_dates",
    f"""SELECT 'seen' AS field, min(seen) AS earliest_date, max(seen) AS latest_date, {day_range("min(seen)", "max(seen)")} AS date_range_days
FROM ({LATE_DATES})""",
)
def freshness_late_dates(spark, sf_dir):
    return T.freshness(spark.sql(LATE_DATES.replace("FROM events", f"FROM parquet.`{sf_dir}/events.parquet`")))


# --- scores and issues from profile rows ---------------------------------------------------------------------------------

TABLE_SCORES = """SELECT table_name, max(total) AS total_records, count(*) AS total_attributes,
  greatest(0, least(100, round(avg(quality_score) + CASE WHEN count(*) BETWEEN 5 AND 20 THEN 5 WHEN count(*) > 50 THEN -5 ELSE 0 END, 2)))::DOUBLE AS data_quality_score,
  sum(n_flags)::BIGINT AS total_anomalies, count(*) FILTER (WHERE n_flags > 0) AS affected_attributes,
  round(count(*) FILTER (WHERE n_flags > 0) * 100.0 / count(*), 2) AS anomaly_rate FROM ({rows}) GROUP BY table_name"""


def _profiles(spark, sf_dir, names=SMALL_STAR):
    return profile_all(tables(spark, sf_dir, *names))


@check("table_scores", TABLE_SCORES.format(rows=scored_sql(STAR)))
def table_scores(spark, sf_dir):
    return T.table_scores(_profiles(spark, sf_dir, STAR))


@check(
    "dataset_summary",
    f"""SELECT count(*) AS total_tables, sum(total_records)::BIGINT AS total_records, sum(total_attributes)::BIGINT AS total_attributes,
  round(avg(data_quality_score), 2) AS overall_quality_score, sum(total_anomalies)::BIGINT AS total_anomalies,
  count(*) FILTER (WHERE total_anomalies > 0) AS affected_tables, 'multi_table' AS dataset_type
FROM ({TABLE_SCORES.format(rows=scored_sql(SMALL_STAR))})""",
)
def dataset_summary(spark, sf_dir):
    return T.dataset_summary(_profiles(spark, sf_dir))


FLAG_ROWS = f"SELECT table_name, unnest(string_split(flags, ',')) AS flag FROM ({scored_sql(SMALL_STAR)}) WHERE flags <> ''"


@check("anomaly_types", f"SELECT table_name, flag, count(*) AS n FROM ({FLAG_ROWS}) GROUP BY 1, 2")
def anomaly_types(spark, sf_dir):
    return T.anomaly_types(_profiles(spark, sf_dir))


@check(
    "global_anomalies",
    f"SELECT flag, count(*) AS n, count(DISTINCT table_name) AS affected_tables FROM ({FLAG_ROWS}) GROUP BY 1",
)
def global_anomalies(spark, sf_dir):
    return T.global_anomalies(_profiles(spark, sf_dir))


ISSUES = f"""SELECT table_name, concat('''', attribute, ''' has ', text) AS issue FROM (
  SELECT table_name, attribute, CASE WHEN null_pct > 50 THEN printf('very high null rate (%.1f%%)', null_pct)
    WHEN null_pct > 30 THEN printf('high null rate (%.1f%%)', null_pct) END AS text FROM (SELECT * FROM rows)
  UNION ALL SELECT table_name, attribute, printf('low quality score (%.1f/100)', quality_score) FROM rows WHERE quality_score < 50
  UNION ALL SELECT table_name, attribute, CASE WHEN flag = 'HIGH_NULL_RATE' THEN NULL
    WHEN flag = 'NUMERIC_OUTLIERS_DETECTED' THEN printf('%d numeric outliers', outliers)
    WHEN flag = 'PATTERN_INCONSISTENCY' THEN 'inconsistent data patterns'
    WHEN flag = 'LOW_UNIQUENESS' THEN printf('low uniqueness (%.2f)', ratio)
    ELSE lower(replace(flag, '_', ' ')) END
  FROM (SELECT *, unnest(string_split(flags, ',')) AS flag FROM rows WHERE flags <> '')) WHERE text IS NOT NULL"""

TOP_ISSUES = f"""WITH rows AS ({scored_sql(SMALL_STAR)})
SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY issue) AS INTEGER) AS rank, issue FROM ({ISSUES})"""


@check("top_issues", TOP_ISSUES)
def top_issues(spark, sf_dir):
    return T.top_issues(_profiles(spark, sf_dir))


@check(
    "critical_issues",
    f"""SELECT table_name, rank, issue FROM ({TOP_ISSUES}) ORDER BY list_position({list(SMALL_STAR)}, table_name), rank""",
)
def critical_issues(spark, sf_dir):
    return T.critical_issues(_profiles(spark, sf_dir), table_positions(spark, SMALL_STAR))


@check(
    "issues_nulls",
    """SELECT 'main_table' AS table_name, concat('''customer_id'' has high null rate (',
  printf('%.1f', round(count(*) FILTER (WHERE o_orderkey % 3 = 0) * 100.0 / count(*), 2)), '%)') AS issue FROM orders HAVING count(*) FILTER (WHERE o_orderkey % 3 = 0) * 100.0 / count(*) > 30
UNION ALL SELECT 'main_table', '''o_orderstatus'' has low uniqueness (0.00)'
UNION ALL SELECT 'main_table', '''o_orderstatus'' has avg length too short'""",
)
def issues_nulls(spark, sf_dir):
    from datagauge.operators.profile import profile

    return T.attribute_issues(profile(derived(spark, sf_dir, ORDERS_WITH_NULLS)))
