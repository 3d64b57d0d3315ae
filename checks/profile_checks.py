"""Checks of the column profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from datagauge.operators import frequency, grouped, outliers, profile, records
from datagauge.params import PATTERNS, UUID_PATTERN, Thresholds

from .registry import MIXED, ORDERS_WITH_NULLS, check, derived, rounded, table, tables, union_all

COLUMNS = {
    "region": {"r_regionkey": "integer", "r_name": "string"},
    "nation": {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"},
    "customer": {
        "c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float",
        "c_mktsegment": "string",
    },
    "supplier": {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "float"},
    "part": {
        "p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer",
        "p_retailprice": "float",
    },
    "orders": {
        "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float",
        "o_orderdate": "datetime", "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
        "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime",
    },
}

NUMERIC = (
    "attribute", "data_type", "present_count", "null_count", "null_percentage", "unique_count", "unique_ratio",
    "min_value", "max_value", "mean", "median", "std", "p1", "p5", "p25", "p75", "p95", "p99", "outlier_count",
)


def outlier_cte(source: str, column: str) -> str:
    """Common table expressions that end in ``flags``: one row per value with the three tests."""
    return f"""
  v AS (SELECT CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL),
  s AS (SELECT count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd, quantile_cont(x, 0.25) AS q1,
               quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM v),
  a AS (SELECT median(abs(x - med)) AS mad FROM v, s),
  flags AS (
    SELECT x, n >= 3 AND sd > 0 AND abs(x - m) / nullif(sd, 0) > 3 AS z,
           n >= 3 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS i,
           n >= 3 AND mad > 0 AND abs(0.6745 * (x - med) / nullif(mad, 0)) > 3.5 AS mz,
           q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
    FROM v, s, a)"""


def numeric_sql(source: str, column: str, kind: str) -> str:
    quantiles = ", ".join(
        f"round((SELECT quantile_cont(x, {p / 100}) FROM v), 4) AS p{p}" for p in (1, 5, 25, 75, 95, 99)
    )
    return f"""SELECT * FROM (WITH {outlier_cte(source, column)}
SELECT '{column}' AS attribute, '{kind}' AS data_type, (SELECT n FROM s) AS present_count,
  t.total - (SELECT n FROM s) AS null_count, round((t.total - (SELECT n FROM s)) * 100.0 / t.total, 2) AS null_percentage,
  t.uniq AS unique_count, round(t.uniq * 1.0 / (SELECT n FROM s), 3) AS unique_ratio,
  (SELECT min(x) FROM v) AS min_value, (SELECT max(x) FROM v) AS max_value, round((SELECT m FROM s), 4) AS mean,
  round((SELECT med FROM s), 4) AS median, round((SELECT sd FROM s), 4) AS std, {quantiles},
  (SELECT count(*) FROM flags WHERE z OR i OR mz) AS outlier_count
FROM (SELECT count(*) AS total, count(DISTINCT {column}) AS uniq FROM {source}) t)"""


def _register_numeric(name: str) -> None:
    numeric = {c: k for c, k in COLUMNS[name].items() if k in ("integer", "float")}
    sql = union_all([numeric_sql(name, c, k) for c, k in numeric.items()])

    @check(f"profile_{name}", sql)
    def query(spark, sf_dir):
        df = table(spark, sf_dir, name)
        return profile.profile(df, name).where(F.col("data_type").isin("integer", "float")).select(*NUMERIC)


for _name in ("lineitem", "orders", "customer", "part", "supplier"):
    _register_numeric(_name)


# --- strings ------------------------------------------------------------------------------------------------------

STRING_COLUMNS = (
    "attribute", "present_count", "null_count", "unique_count", "unique_ratio", "min_length", "max_length",
    "avg_length", "median_length", "std_length", "length_p25", "length_p75", "length_p95",
)


def string_sql(source: str, column: str) -> str:
    v = f"nullif({column}, '')"
    return f"""SELECT '{column}' AS attribute, count({v}) AS present_count, count(*) - count({v}) AS null_count,
  count(DISTINCT {v}) AS unique_count, round(count(DISTINCT {v}) * 1.0 / count({v}), 3) AS unique_ratio,
  min(length({v})) AS min_length, max(length({v})) AS max_length, round(avg(length({v})), 2) AS avg_length,
  round(median(length({v})), 2) AS median_length, round(stddev_pop(length({v})), 2) AS std_length,
  CAST(floor(quantile_cont(length({v}), 0.25)) AS BIGINT) AS length_p25,
  CAST(floor(quantile_cont(length({v}), 0.75)) AS BIGINT) AS length_p75,
  CAST(floor(quantile_cont(length({v}), 0.95)) AS BIGINT) AS length_p95
FROM {source}"""


def _register_strings(name: str, columns: tuple[str, ...]) -> None:
    @check(f"string_lengths_{name}", union_all([string_sql(name, c) for c in columns]))
    def query(spark, sf_dir):
        df = table(spark, sf_dir, name).select(*columns)
        return profile.profile(df, name).select(*STRING_COLUMNS)


_register_strings("documents", ("text", "lang", "source"))
_register_strings("customer", ("c_name", "c_mktsegment"))
_register_strings("pages", ("url", "html"))
_register_strings("conversations", ("role", "text"))


def charset_sql(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS attribute, round(a * 100.0 / t, 2) AS alphabetic_pct, round(d * 100.0 / t, 2) AS numeric_pct,
  round(o * 100.0 / t, 2) AS alphanumeric_pct, round(w * 100.0 / t, 2) AS whitespace_pct,
  round(u * 100.0 / t, 2) AS unicode_pct, round((t - a - d - o - w - u) * 100.0 / t, 2) AS special_chars_pct
FROM (SELECT sum(length({column})) AS t,
  sum(length(regexp_replace({column}, '[^\\p{{L}}]', '', 'g'))) AS a,
  sum(length(regexp_replace({column}, '[^\\p{{Nd}}²³¹]', '', 'g'))) AS d,
  sum(length(regexp_replace({column}, '[^\\p{{Nl}}\\p{{No}}]|[²³¹]', '', 'g'))) AS o,
  sum(length(regexp_replace({column}, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]', '', 'g'))) AS w,
  sum(length(regexp_replace({column}, '[\\x00-\\x7F\\p{{L}}\\p{{N}}\\p{{Z}}\\x{{85}}]', '', 'g'))) AS u
  FROM {source})"""


CHARSET = (
    "attribute", "alphabetic_pct", "numeric_pct", "alphanumeric_pct", "whitespace_pct", "unicode_pct",
    "special_chars_pct",
)


@check("charset_documents", union_all([charset_sql("documents", c) for c in ("text", "lang", "source")]))
def charset_documents(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "documents").select("text", "lang", "source")).select(*CHARSET)


@check("charset_pages", union_all([charset_sql("pages", c) for c in ("url", "html")]))
def charset_pages(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "pages").select("url", "html")).select(*CHARSET)


TEXT_COLUMNS = (
    ("documents", "text"), ("documents", "source"), ("pages", "url"), ("customer", "c_name"),
    ("conversations", "text"), ("part", "p_name"),
)


def _pattern_sql() -> str:
    parts = []
    for source, column in TEXT_COLUMNS:
        for pattern, regex in {**PATTERNS, "uuid": UUID_PATTERN}.items():
            quoted = regex.replace("'", "''")
            parts.append(
                f"SELECT '{source}' AS table_name, '{column}' AS attribute, '{pattern}' AS pattern, "
                f"count(*) AS matches FROM {source} WHERE regexp_matches({column}, '{quoted}')"
            )
    return f"SELECT * FROM ({union_all(parts)}) WHERE matches > 0"


@check("pattern_counts", _pattern_sql())
def pattern_counts(spark, sf_dir):
    patterns = {**PATTERNS, "uuid": UUID_PATTERN}
    parts = []
    for source in dict.fromkeys(s for s, _ in TEXT_COLUMNS):
        columns = [c for s, c in TEXT_COLUMNS if s == source]
        found = profile.pattern_counts(table(spark, sf_dir, source), patterns, columns)
        parts.append(found.select(F.lit(source).alias("table_name"), "attribute", "pattern", "matches"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@check(
    "pattern_dominant",
    """SELECT 'url' AS attribute, 'url' AS dominant_pattern, count(*) AS url_matches,
       round(count(*) * 100.0 / (SELECT count(*) FROM pages), 2) AS best_pattern_pct
FROM pages WHERE regexp_matches(url, '^https?://[^\\s]+$')""",
)
def pattern_dominant(spark, sf_dir):
    df = profile.profile(table(spark, sf_dir, "pages").select("url"))
    return df.select("attribute", "dominant_pattern", "url_matches", "best_pattern_pct")


@check(
    "top_values",
    union_all(
        [
            f"SELECT '{c}' AS attribute, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, {c} AS value, "
            f"count(*) AS n FROM documents GROUP BY {c} QUALIFY rank <= 5"
            for c in ("text", "lang", "source")
        ]
    ),
)
def top_values(spark, sf_dir):
    return frequency.top_values(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@check(
    "top_values_first_seen",
    union_all(
        [
            f"SELECT '{c}' AS attribute, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS rank, "
            f"{c} AS value, count(*) AS n FROM events GROUP BY {c} QUALIFY rank <= 5"
            for c in ("event_type", "props")
        ]
    ),
)
def top_values_first_seen(spark, sf_dir):
    return frequency.top_values(table(spark, sf_dir, "events"), ["event_type", "props"], order_by="event_id")


@check(
    "distinct_counts",
    union_all(
        [
            f"SELECT '{c}' AS attribute, count(DISTINCT {c}) AS unique_count FROM {t}"
            for t in ("lineitem", "documents")
            for c in (COLUMNS.get(t) or ("doc_id", "text", "lang", "source", "n_chars"))
        ]
    ),
)
def distinct_counts(spark, sf_dir):
    found = tables(spark, sf_dir, "lineitem", "documents")
    return frequency.distinct_counts(found["lineitem"]).unionByName(frequency.distinct_counts(found["documents"]))


# --- types, booleans, arrays, objects --------------------------------------------------------------------------------

NUMBER = "^\\s*[+-]?(\\d+(_\\d+)*\\.?(\\d+(_\\d+)*)?|\\.\\d+(_\\d+)*)([eE][+-]?\\d+(_\\d+)*)?\\s*$"


def vote_sql(source: str, column: str, order: str) -> str:
    return f"""SELECT CASE WHEN NOT regexp_matches({column}, '{NUMBER}') THEN 'string'
    WHEN contains({column}, '.') THEN 'float' ELSE 'integer' END AS type_tag, count(*) AS votes, min({order}) AS first_at
FROM {source} WHERE {column} <> '' GROUP BY 1"""


@check("type_vote_mixed", vote_sql(f"({MIXED})", "v", "ord"))
def type_vote_mixed(spark, sf_dir):
    return profile.type_vote(derived(spark, sf_dir, MIXED), "v", "ord")


@check("type_vote_documents", vote_sql("documents", "text", "doc_id"))
def type_vote_documents(spark, sf_dir):
    return profile.type_vote(table(spark, sf_dir, "documents"), "text", "doc_id")


@check(
    "type_vote_values",
    "SELECT 'float' AS type_tag, count(value) AS votes, min(event_id) AS first_at FROM events WHERE value IS NOT NULL",
)
def type_vote_values(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").alias("v"))
    return profile.type_vote(df, "v", "event_id")


@check(
    "type_vote_variant",
    "SELECT 'integer' AS type_tag, count(*) AS votes, min(event_id) AS first_at FROM events",
)
def type_vote_variant(spark, sf_dir):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "variant")
    return profile.type_vote(table(spark, sf_dir, "events").select("event_id", k.alias("v")), "v", "event_id")


@check(
    "boolean_summary",
    union_all(
        [
            f"""SELECT '{n}' AS attribute, count(*) FILTER (WHERE {e}) AS true_count, count(*) FILTER (WHERE NOT ({e})) AS false_count,
  round(count(*) FILTER (WHERE {e}) * 100.0 / count(*), 2) AS true_percentage,
  round(count(*) FILTER (WHERE NOT ({e})) * 100.0 / count(*), 2) AS false_percentage FROM labels"""
            for n, e in (("good", "quality = 1"), ("toxic", "toxic = 1"))
        ]
    ),
)
def boolean_summary(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    columns = ("attribute", "true_count", "false_count", "true_percentage", "false_percentage")
    return profile.column_metrics(df).join(
        profile.profile(df).select("attribute", "true_percentage", "false_percentage"), "attribute"
    ).select(*columns)


@check(
    "array_lengths",
    """SELECT 'embedding' AS attribute, 'array' AS data_type, min(len(embedding)) AS min_length,
  max(len(embedding)) AS max_length, round(avg(len(embedding)), 2) AS avg_length,
  round(median(len(embedding)), 2) AS median_length, count(*) FILTER (WHERE len(embedding) = 0) AS empty_arrays FROM embeddings""",
)
def array_lengths(spark, sf_dir):
    df = profile.profile(table(spark, sf_dir, "embeddings").select("embedding"))
    return df.select("attribute", "data_type", "min_length", "max_length", "avg_length", "median_length", "empty_arrays")


@check("element_types", "SELECT 'float' AS element_type, sum(len(embedding))::BIGINT AS n FROM embeddings")
def element_types(spark, sf_dir):
    return profile.element_types(table(spark, sf_dir, "embeddings"), "embedding")


WORDS_JSON = "SELECT doc_id, to_json(split(text, ' ')) AS words FROM documents"


@check(
    "element_types_json",
    f"""SELECT CASE WHEN NOT regexp_matches(w, '{NUMBER}') THEN 'string' WHEN contains(w, '.') THEN 'float'
  ELSE 'integer' END AS element_type, count(*) AS n
FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1""",
)
def element_types_json(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.to_json(F.split("text", " ")).alias("words"))
    return profile.element_types(df, "words").where("element_type is not null")


@check(
    "object_keys",
    "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
)
def object_keys(spark, sf_dir):
    return profile.object_keys(table(spark, sf_dir, "events"), "props")


@check(
    "object_summary",
    """SELECT (SELECT count(DISTINCT k) FROM (SELECT unnest(json_keys(props)) AS k FROM events)) AS unique_keys,
  round(avg(len(json_keys(props))), 2) AS avg_keys_per_object, 1.0::DOUBLE AS key_consistency FROM events""",
)
def object_summary(spark, sf_dir):
    return profile.object_summary(table(spark, sf_dir, "events"), "props")


@check(
    "object_profile",
    """SELECT 'item' AS attribute, 'object' AS data_type, count(*) AS present_count, 2::BIGINT AS unique_keys,
  2.0::DOUBLE AS avg_keys_per_object, 1.0::DOUBLE AS key_consistency FROM events""",
)
def object_profile(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.struct("event_type", "user_id").alias("item"))
    columns = ("attribute", "data_type", "present_count", "unique_keys", "avg_keys_per_object", "key_consistency")
    return profile.profile(df).select(*columns)


# --- records without a schema ------------------------------------------------------------------------------------------

# Events as JSON records: some keys are missing from some records, blank, or of another type.
RECORDS = """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS amount, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS kind,
       event_type, event_id % 5 AS n, event_id % 3 = 0 AS late, user_id FROM events"""


def event_records(spark, sf_dir):
    """``(event_type, event_id, record)``; a null field leaves its key out."""
    df = derived(spark, sf_dir, RECORDS)
    own = ["event_id", "amount", "kind"]
    listed = F.when(F.col("n") > 0, F.slice(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), 1, F.col("n").cast("int"))).alias("items")
    held = F.when(F.col("n") > 1, F.create_map(F.concat(F.lit("k"), F.col("n")), F.col("user_id"))).alias("held")
    early = F.to_json(F.struct(*own, listed, held, F.col("late"), F.col("event_id").alias("code")))
    late = F.to_json(F.struct(*own, listed, held, F.col("late"), F.lit("n/a").alias("code")))
    return df.select("event_type", "event_id", F.parse_json(F.when(F.col("late"), late).otherwise(early)).alias("record"))


@check("profile_variant", union_all([numeric_sql(f"({RECORDS})", c, k) for c, k in (("event_id", "integer"), ("amount", "float"))]))
def profile_variant(spark, sf_dir):
    df = records.profile_variant(event_records(spark, sf_dir), "record", order_by="event_id")
    return df.where(F.col("attribute").isin("event_id", "amount")).select(*NUMERIC)


@check("profile_variant_strings", f"{string_sql(f'({RECORDS})', 'kind')}")
def profile_variant_strings(spark, sf_dir):
    return records.profile_variant(event_records(spark, sf_dir), "record").where("attribute = 'kind'").select(*STRING_COLUMNS)


@check("profile_variant_charset", charset_sql(f"(SELECT * FROM ({RECORDS}) WHERE kind <> '')", "kind"))
def profile_variant_charset(spark, sf_dir):
    return records.profile_variant(event_records(spark, sf_dir), "record").where("attribute = 'kind'").select(*CHARSET)


@check(
    "profile_variant_mixed",
    f"""SELECT event_type AS table_name, 'code' AS attribute, 'integer' AS data_type, count(*) AS total_count, count(*) AS present_count,
  count(*) FILTER (WHERE NOT late) + 1 AS unique_count, min(event_id) FILTER (WHERE NOT late)::DOUBLE AS min_value,
  round(avg(event_id) FILTER (WHERE NOT late), 4) AS mean, NULL::BIGINT AS max_length, NULL::BIGINT AS true_count, NULL::BIGINT AS unique_keys
FROM ({RECORDS}) GROUP BY 1
UNION ALL
SELECT event_type, 'items', 'array', count(*), count(*) FILTER (WHERE n > 0), count(DISTINCT n) FILTER (WHERE n > 0), NULL, NULL, max(n), NULL, NULL FROM ({RECORDS}) GROUP BY 1
UNION ALL
SELECT event_type, 'late', 'boolean', count(*), count(*), 2, NULL, NULL, NULL, count(*) FILTER (WHERE late), NULL FROM ({RECORDS}) GROUP BY 1
UNION ALL
SELECT event_type, 'held', 'object', count(*), count(*) FILTER (WHERE n > 1), count(DISTINCT (n, user_id)) FILTER (WHERE n > 1), NULL, NULL, NULL, NULL, 3 FROM ({RECORDS}) GROUP BY 1""",
)
def profile_variant_mixed(spark, sf_dir):
    df = records.profile_variant(event_records(spark, sf_dir), "record", table_name="event_type", order_by="event_id")
    columns = ("table_name", "attribute", "data_type", "total_count", "present_count", "unique_count", "min_value", "mean", "max_length", "true_count", "unique_keys")
    return df.where(F.col("attribute").isin("code", "items", "late", "held")).select(*columns)


TIED = """SELECT event_id, -event_id AS back, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '5' END AS a, CASE WHEN event_id % 2 = 0 THEN '1.5' WHEN event_id % 2 = 1 THEN 'y' END AS b,
  CASE WHEN event_id % 3 = 0 THEN '7' WHEN event_id % 3 = 1 THEN '' ELSE '2.5' END AS c FROM events"""


def tied_sql(column: str, order: str) -> str:
    votes = f"SELECT tag, count(*) AS votes, min({order}) AS first_at FROM (SELECT *, CASE WHEN NOT regexp_matches({column}, '{NUMBER}') THEN 'string' WHEN contains({column}, '.') THEN 'float' ELSE 'integer' END AS tag FROM ({TIED}) WHERE {column} <> '') GROUP BY tag"
    return f"SELECT '{column}' AS attribute, '{order}' AS by, (SELECT tag FROM ({votes}) ORDER BY votes DESC, first_at LIMIT 1) AS data_type"


@check("profile_type_ties", union_all([tied_sql(c, o) for c in "abc" for o in ("event_id", "back")]))
def profile_type_ties(spark, sf_dir):
    df = derived(spark, sf_dir, TIED)
    parts = [profile.column_metrics(df, order_by=o).select("attribute", F.lit(o).alias("by"), F.expr(profile._VOTED_TYPE).alias("data_type")).where(F.col("attribute").isin("a", "b", "c")) for o in ("event_id", "back")]
    return parts[0].unionByName(parts[1])


# --- flags, scores, nulls ----------------------------------------------------------------------------------------------


def facts_sql(source: str, column: str, kind: str, name: str | None = None) -> str:
    """One row of what flags and scores are made of."""
    v = f"nullif({column}, '')" if kind == "string" else column
    length = f"avg(length({v}))" if kind == "string" else "NULL"
    low = f"min({column})" if kind in ("integer", "float") else "NULL"
    if kind in ("integer", "float"):
        count = f"(WITH {outlier_cte(source, column)} SELECT count(*) FROM flags WHERE z OR i OR mz)"
    else:
        count = "0"
    best = "0"
    if kind == "string":
        shares = [
            f"count(*) FILTER (WHERE regexp_matches({v}, '{p}')) * 100.0 / nullif(count({v}), 0)" for p in PATTERNS.values()
        ]
        best = f"greatest({', '.join(shares)})"
    return f"""SELECT '{name or source}' AS table_name, '{column}' AS attribute, '{kind}' AS data_type, count(*) AS total,
  count({v}) AS present, round((count(*) - count({v})) * 100.0 / count(*), 2) AS null_pct,
  round(count(DISTINCT {v}) * 1.0 / nullif(count({v}), 0), 3) AS ratio, round(CAST({length} AS DOUBLE), 2) AS avg_len,
  CAST({low} AS DOUBLE) AS low, {count} AS outliers, round(CAST({best} AS DOUBLE), 2) AS best FROM {source}"""


FLAGGED = """SELECT *, concat_ws(',',
    CASE WHEN null_pct > 30 THEN 'HIGH_NULL_RATE' END, CASE WHEN avg_len < 2 THEN 'AVG_LENGTH_TOO_SHORT' END,
    CASE WHEN avg_len > 500 THEN 'AVG_LENGTH_TOO_LONG' END, CASE WHEN outliers > 0 THEN 'NUMERIC_OUTLIERS_DETECTED' END,
    CASE WHEN low < 0 THEN 'NEGATIVE_VALUES_DETECTED' END,
    CASE WHEN ratio < 0.1 AND present > 10 THEN 'LOW_UNIQUENESS' END,
    CASE WHEN best > 50 AND best < 90 THEN 'PATTERN_INCONSISTENCY' END) AS flags"""

SCORED = """SELECT *, CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END AS n_flags,
  greatest(0, least(100, round(100 - least(null_pct * 0.5, 30)
    - 10 * CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END
    + CASE WHEN ratio BETWEEN 0.1 AND 0.9 THEN 10 WHEN ratio > 0.95 THEN 5 ELSE 0 END, 2)))::DOUBLE AS quality_score"""


def scored_sql(names: tuple[str, ...]) -> str:
    """Scored profile rows of star tables, as a subquery body."""
    facts = union_all([facts_sql(t, c, k) for t in names for c, k in COLUMNS[t].items()])
    return f"{SCORED} FROM ({FLAGGED} FROM ({facts}))"


@check(
    "profile_flags_scores",
    f"""SELECT table_name, attribute, data_type, flags AS anomaly_flags, quality_score
FROM ({scored_sql(tuple(COLUMNS))})""",
)
def profile_flags_scores(spark, sf_dir):
    df = profile.profile_all(tables(spark, sf_dir, *COLUMNS))
    return df.select(
        "table_name", "attribute", "data_type", F.array_join("anomaly_flags", ",").alias("anomaly_flags"), "quality_score"
    )


NULL_COLUMNS = {"o_orderkey": "integer", "customer_id": "integer", "o_orderstatus": "string", "o_totalprice": "float"}


@check(
    "profile_nulls",
    f"""SELECT attribute, total AS total_count, present AS present_count, total - present AS null_count, null_pct AS null_percentage,
  ratio AS unique_ratio, flags AS anomaly_flags, quality_score
FROM ({SCORED} FROM ({FLAGGED} FROM (
{union_all([facts_sql(f"({ORDERS_WITH_NULLS})", c, k, "v") for c, k in NULL_COLUMNS.items()])})))""",
)
def profile_nulls(spark, sf_dir):
    df = profile.profile(derived(spark, sf_dir, ORDERS_WITH_NULLS))
    return df.select(
        "attribute", "total_count", "present_count", "null_count", "null_percentage", "unique_ratio",
        F.array_join("anomaly_flags", ",").alias("anomaly_flags"), "quality_score",
    )


# --- outliers -----------------------------------------------------------------------------------------------------------

OUTLIER_COLUMNS = (("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("events", "value"), ("documents", "n_chars"))


def _outlier_sql(source: str, column: str) -> str:
    return f"""SELECT * FROM (WITH {outlier_cte(source, column)}
SELECT '{column}' AS attribute, count(*) FILTER (WHERE z) AS z_score_count, count(*) FILTER (WHERE i) AS iqr_count, count(*) FILTER (WHERE mz) AS modified_z_count,
  count(*) FILTER (WHERE z OR i OR mz) AS outlier_count, round(max(lo), 4) AS lower_bound, round(max(hi), 4) AS upper_bound FROM flags)"""


@check("outlier_counts", union_all([_outlier_sql(*pair) for pair in OUTLIER_COLUMNS]))
def outlier_counts(spark, sf_dir):
    parts = []
    for source in dict.fromkeys(s for s, _ in OUTLIER_COLUMNS):
        columns = {c: F.col(c).cast("double") for s, c in OUTLIER_COLUMNS if s == source}
        parts.append(outliers.outlier_counts(table(spark, sf_dir, source), columns))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("outlier_counts_bracket", union_all([_outlier_sql(*pair) for pair in OUTLIER_COLUMNS[:2]]))
def outlier_counts_bracket(spark, sf_dir):
    columns = {c: F.col(c).cast("double") for s, c in OUTLIER_COLUMNS[:2]}
    return outliers.outlier_counts(table(spark, sf_dir, "lineitem"), columns)


def _rows_sql(source: str, key: str, column: str) -> str:
    return f"""WITH s AS (SELECT avg({column}) AS m, stddev_pop({column}) AS sd, quantile_cont({column}, 0.25) AS q1,
    quantile_cont({column}, 0.5) AS med, quantile_cont({column}, 0.75) AS q3 FROM {source}),
  a AS (SELECT median(abs({column} - med)) AS mad FROM {source}, s)
SELECT * FROM (SELECT {key}, {column}, abs({column} - m) / sd > 3 AS is_z_score,
    {column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1) AS is_iqr,
    abs(0.6745 * ({column} - med) / mad) > 3.5 AS is_modified_z_score FROM {source}, s, a)
WHERE is_z_score OR is_iqr OR is_modified_z_score"""


@check("outlier_rows_events", _rows_sql("events", "event_id", "value"))
def outlier_rows_events(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    return outliers.outlier_rows(df, "value")


@check("outlier_rows_documents", _rows_sql("documents", "doc_id", "n_chars"))
def outlier_rows_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return outliers.outlier_rows(df, "n_chars")


def _grouped_cte(source: str, keys: str, column: str) -> str:
    """Common table expressions that end in ``flags``: the rows of a table with the tests inside their group."""
    on = " AND ".join(f"{{0}}.{k.strip()} IS NOT DISTINCT FROM {{1}}.{k.strip()}" for k in keys.split(","))
    return f"""
  s AS (SELECT {keys}, count({column}) AS n, avg({column}) AS m, stddev_pop({column}) AS sd, quantile_cont({column}, 0.25) AS q1,
               quantile_cont({column}, 0.5) AS med, quantile_cont({column}, 0.75) AS q3 FROM {source} GROUP BY {keys}),
  a AS (SELECT {", ".join("s." + k.strip() for k in keys.split(","))}, median(abs({column} - med)) AS mad FROM {source} t JOIN s ON {on.format("t", "s")} GROUP BY ALL),
  flags AS (
    SELECT t.*, s.n, n >= 3 AND sd > 0 AND abs({column} - m) / nullif(sd, 0) > 3 AS z,
           n >= 3 AND ({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS i,
           n >= 3 AND mad > 0 AND abs(0.6745 * ({column} - med) / nullif(mad, 0)) > 3.5 AS mz,
           q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
    FROM {source} t JOIN s ON {on.format("t", "s")} JOIN a ON {on.format("t", "a")})"""


GROUPED = (("lineitem", "l_suppkey", ("l_extendedprice", "l_quantity")), ("events", "event_type", ("value",)), ("events", "user_id", ("value",)))


def _group_counts_sql(source: str, key: str, column: str) -> str:
    return f"""SELECT * FROM (WITH {_grouped_cte(source, key, column)}
SELECT {key}::VARCHAR AS grp, '{column}' AS attribute, max(n) AS total, count(*) FILTER (WHERE z) AS z_score_count, count(*) FILTER (WHERE i) AS iqr_count,
  count(*) FILTER (WHERE mz) AS modified_z_count, count(*) FILTER (WHERE z OR i OR mz) AS outlier_count FROM flags WHERE {column} IS NOT NULL GROUP BY {key})"""


@check("outliers_by_group", union_all([_group_counts_sql(t, k, c) for t, k, cs in GROUPED for c in cs]))
def outliers_by_group(spark, sf_dir):
    parts = []
    for source, key, columns in GROUPED:
        found = grouped.outlier_counts_by_group(table(spark, sf_dir, source), [key], {c: F.col(c) for c in columns})
        parts.append(found.withColumn("grp", F.col(key).cast("string")).drop(key, "lower_bound", "upper_bound"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check(
    "outlier_rows_by_group",
    f"""WITH {_grouped_cte("events", "event_type, user_id", "value")}
SELECT event_id, event_type, user_id, value, z AS is_z_score, i AS is_iqr, mz AS is_modified_z_score FROM flags WHERE z OR i OR mz""",
)
def outlier_rows_by_group(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    return grouped.outlier_rows_by_group(df, ["event_type", "user_id"], "value")


@check(
    "quantiles_by_group",
    union_all(
        [
            f"SELECT {k} AS grp, '{c}' AS attribute, count({c}) AS total, quantile_cont({c}::DOUBLE, 0.1) AS p10, "
            f"quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.99) AS p99 FROM {t} GROUP BY {k}"
            for t, k, c in (("lineitem", "l_returnflag", "l_extendedprice"), ("lineitem", "l_returnflag", "l_quantity"), ("documents", "lang", "n_chars"))
        ]
    ),
)
def quantiles_by_group(spark, sf_dir):
    items = grouped.group_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {c: F.col(c) for c in ("l_extendedprice", "l_quantity")}, (0.1, 0.5, 0.99))
    docs = grouped.group_quantiles(table(spark, sf_dir, "documents"), ["lang"], {"n_chars": F.col("n_chars")}, (0.1, 0.5, 0.99))
    both = items.withColumnRenamed("l_returnflag", "grp").unionByName(docs.withColumnRenamed("lang", "grp"))
    return both.select("grp", "attribute", "total", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("p10", "p50", "p99"))])


# --- plain profile ------------------------------------------------------------------------------------------------------


def basic_sql(source: str, column: str, kind: str) -> str:
    number = kind in ("integer", "float")
    x = f"CAST({column} AS DOUBLE)"

    def when(test: bool, expression: str, cast: str) -> str:
        return f"CAST({expression if test else 'NULL'} AS {cast})"

    return f"""SELECT '{column}' AS attribute, '{kind}' AS data_type, count({column}) AS present_count,
  count(*) - count({column}) AS null_count, (count(*) - count({column})) * 100.0 / count(*) AS null_percentage,
  count(DISTINCT {column}) AS unique_count,
  greatest(0, 100 - least((count(*) - count({column})) * 100.0 / count(*), 50)
    - CASE WHEN count(DISTINCT {column}) = 1 THEN 20 ELSE 0 END)::DOUBLE AS quality_score,
  {when(number, f"min({x})", "DOUBLE")} AS min_value, {when(number, f"max({x})", "DOUBLE")} AS max_value,
  {when(number, f"round(avg({x}), 6)", "DOUBLE")} AS mean, {when(number, f"round(median({x}), 6)", "DOUBLE")} AS median,
  {when(number, f"round(stddev_samp({x}), 6)", "DOUBLE")} AS std,
  {when(kind == "string", f"min(length({column}))", "INTEGER")} AS min_length,
  {when(kind == "string", f"max(length({column}))", "INTEGER")} AS max_length,
  {when(kind == "string", f"round(avg(length({column})), 6)", "DOUBLE")} AS avg_length,
  {when(kind == "datetime", f"min({column})", "VARCHAR")} AS min_date,
  {when(kind == "datetime", f"max({column})", "VARCHAR")} AS max_date,
  {when(kind == "datetime", f"date_diff('day', min({column}), max({column}))", "INTEGER")} AS date_range_days
FROM {source}"""


@check(
    "profile_basic",
    union_all([basic_sql(t, c, k) for t in ("part", "orders") for c, k in COLUMNS[t].items()]),
)
def profile_basic(spark, sf_dir):
    parts = [profile.basic_profile(df) for df in tables(spark, sf_dir, "part", "orders").values()]
    both = rounded(parts[0].unionByName(parts[1]), {"mean": 6, "median": 6, "std": 6, "avg_length": 6})
    return both.withColumns({c: F.col(c).cast("string") for c in ("min_date", "max_date")})


# --- parameters in the caller's hands -------------------------------------------------------------------------------------

OWN_PATTERNS = {"code": "^[A-Z]+#[0-9]+$", "words": "^[a-z]+ [a-z]+$"}
OWN_LIMITS = Thresholds(high_null_pct=101.0, short_avg_length=20.0, long_avg_length=21.0, low_unique_ratio=1.1, iqr_multiplier=0.5, z_score=1.5, modified_z_score=2.0)


@check(
    "profile_own_patterns",
    union_all(
        [
            f"""SELECT '{c}' AS attribute, count(*) FILTER (WHERE regexp_matches({c}, '{OWN_PATTERNS["code"]}')) AS code_matches,
  count(*) FILTER (WHERE regexp_matches({c}, '{OWN_PATTERNS["words"]}')) AS words_matches FROM part"""
            for c in ("p_name", "p_brand", "p_type")
        ]
    ),
)
def profile_own_patterns(spark, sf_dir):
    df = profile.profile(table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type"), patterns=OWN_PATTERNS)
    return df.select("attribute", "code_matches", "words_matches")


@check(
    "outliers_own_limits",
    f"""WITH {outlier_cte("orders", "o_totalprice").replace("> 3 AS z", "> 1.5 AS z").replace("1.5 * (q3 - q1)", "0.5 * (q3 - q1)").replace("> 3.5 AS mz", "> 2.0 AS mz")}
SELECT 'o_totalprice' AS attribute, count(*) FILTER (WHERE z) AS z_score_count, count(*) FILTER (WHERE i) AS iqr_count, count(*) FILTER (WHERE mz) AS modified_z_count FROM flags""",
)
def outliers_own_limits(spark, sf_dir):
    found = outliers.outlier_counts(table(spark, sf_dir, "orders"), {"o_totalprice": F.col("o_totalprice")}, OWN_LIMITS)
    return found.select("attribute", "z_score_count", "iqr_count", "modified_z_count")


@check(
    "flags_own_limits",
    """SELECT 'p_name' AS attribute, concat_ws(',', CASE WHEN avg(length(p_name)) < 20 THEN 'AVG_LENGTH_TOO_SHORT' END, CASE WHEN round(avg(length(p_name)), 2) > 21 THEN 'AVG_LENGTH_TOO_LONG' END, 'LOW_UNIQUENESS') AS flags FROM part
UNION ALL SELECT 'p_brand', 'AVG_LENGTH_TOO_SHORT,LOW_UNIQUENESS'""",
)
def flags_own_limits(spark, sf_dir):
    df = profile.profile(table(spark, sf_dir, "part").select("p_name", "p_brand"), patterns={}, limits=OWN_LIMITS)
    return df.select("attribute", F.array_join("anomaly_flags", ",").alias("flags"))
