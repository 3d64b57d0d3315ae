"""Checks of record rules, issue classes and quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from datagauge.functions import dates, numbers
from datagauge.operators import issues as I
from datagauge.operators import rules
from datagauge.operators.profile import profile
from datagauge.operators.tables import table_scores

from .registry import ORDERS_WITH_NULLS, PEOPLE, check, derived, table, union_all

AS_OF = "2024-12-31"
EMAIL = "^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$"

# Every people row with the parsed fields the rules compare.
FACTS = f"""SELECT *, 'User ' || rid AS u, lower(split_part(email, '@', 1)) AS local,
    regexp_replace(CASE WHEN contains(lower(name), ' ') THEN split_part(lower(name), ' ', 1) ELSE lower(name) END, '[^a-z]', '', 'g') AS na,
    regexp_replace(lower(split_part(email, '@', 1)), '[0-9._-]', '', 'g') AS eb,
    date_diff('day', day, DATE '{AS_OF}') / 365.25 AS years,
    regexp_replace(phone, '[\\s\\-\\(\\)\\+\\.]', '', 'g') AS digits
  FROM (SELECT *, CAST(pos AS VARCHAR) AS rid, try_cast(signup_date AS DATE) AS day,
          CAST(replace(order_date, '/', '-') AS DATE) AS bought, try_cast(last_login AS DATE) AS login
        FROM (SELECT *, concat('Record_', customer_id) AS pos FROM ({PEOPLE})))"""


def _case(rule, kind, category, severity, field, condition, message):
    """One alternative of a rule: what it reports, when, and its text after the user."""
    return (
        f"SELECT rid AS record_id, '{rule}' AS rule, '{kind}' AS kind, '{category}' AS category, '{severity}' AS severity, "
        f"'{field}' AS field, concat('{kind}: ', u, {message}) AS message FROM facts WHERE {condition}"
    )


BUSINESS, MISSING, TYPES = "business_logic_issues", "missing_required_fields", "data_type_violations"
CASES = (
    _case("V02", "CRITICAL", "future_dates", "CRITICAL", "signup_date", f"day > DATE '{AS_OF}'", "' has future signup date: ', signup_date"),
    _case("V03", "TEMPORAL ANOMALY", "temporal_issues", "LOW", "signup_date", "years > 50", "' has signup date ', printf('%.1f', years), ' years ago: ', signup_date"),
    _case("V04", "CRITICAL", "future_dates", "CRITICAL", "purchase_date", f"bought > DATE '{AS_OF}'", "' has future purchase date: ', order_date"),
    _case("V05", "LOGICAL ERROR", "impossible_sequences", "HIGH", "purchase_date", "bought < day", "' purchased (', order_date, ') before signup (', signup_date, ')'"),
    _case(
        "V06", "CROSS-FIELD MISMATCH", "cross_field_issues", "MEDIUM", "name",
        """contains(email, '@') AND length(name) > 2 AND length(local) > 2 AND na <> '' AND eb <> ''
        AND NOT contains(eb, na) AND NOT contains(na, eb)
        AND NOT (length(na) >= 3 AND length(eb) >= 3 AND (contains(eb, na[1:3]) OR contains(na, eb[1:3])))""",
        "' name ''', name, ''' doesn''t match email ''', email, ''' (local: ', local, ')'",
    ),
    _case("V07", "AGE INCONSISTENCY", "age_inconsistencies", "MEDIUM", "age", "age - years < 13", "' would have been ', printf('%.1f', age - years), ' years old at signup (too young)'"),
    _case("V07", "AGE INCONSISTENCY", "age_inconsistencies", "MEDIUM", "age", "age - years > 100", "' would have been ', printf('%.1f', age - years), ' years old at signup (unrealistic)'"),
    _case("V08", "EMAIL FORMAT ERROR", "email_format_issues", "HIGH", "email", f"email <> '' AND NOT regexp_matches(email, '{EMAIL}')", "' has invalid email format: ''', email, ''''"),
    _case("V09", "IMPOSSIBLE VALUE", BUSINESS, "CRITICAL", "age", "age < 0", "' has negative age: ', age"),
    _case("V09", "UNREALISTIC VALUE", BUSINESS, "HIGH", "age", "age > 150", "' has age over 150: ', age"),
    _case("V09", "BUSINESS RULE VIOLATION", BUSINESS, "MEDIUM", "age", "age >= 0 AND age < 13", "' below minimum age requirement: ', age"),
    _case("V10", "MISSING REQUIRED FIELD", MISSING, "CRITICAL", "salary", "salary IS NULL", "' has null/missing salary'"),
    _case("V10", "IMPOSSIBLE VALUE", BUSINESS, "CRITICAL", "salary", "salary < 0", "' has negative salary: ', salary"),
    _case("V10", "BUSINESS RULE VIOLATION", BUSINESS, "MEDIUM", "salary", "salary >= 0 AND salary < 15000", "' salary below minimum threshold: ', salary"),
    _case("V11", "MISSING REQUIRED FIELD", MISSING, "CRITICAL", "name", "name = '' OR lower(name) IN ('null', 'none', 'n/a', 'unknown', 'test', 'admin')", "' has empty or invalid name'"),
    _case("V13", "INVALID DATE FORMAT", TYPES, "HIGH", "signup_date", "signup_date = 'invalid-date'", "' has invalid signup_date: ''', signup_date, ''''"),
    _case("V14", "BUSINESS RULE VIOLATION", "future_dates", "CRITICAL", "signup_date", f"day > DATE '{AS_OF}'", "' has future signup_date: ', signup_date"),
    _case("V16", "IMPOSSIBLE SEQUENCE", "impossible_sequences", "HIGH", "signup_date", "day > login", "' has signup_date (', day, ') after last_login (', login, ')'"),
    _case("V18", "INVALID EMAIL FORMAT", "email_format_issues", "HIGH", "email", f"email <> '' AND NOT regexp_matches(email, '{EMAIL}')", "' has invalid email: ''', email, ''''"),
    _case("V18", "BUSINESS RULE VIOLATION", BUSINESS, "MEDIUM", "email", f"regexp_matches(email, '{EMAIL}') AND split_part(email, '@', 2) = 'example.com'", "' has non-business email format: ''', email, ''''"),
    _case("V20", "INVALID BOOLEAN VALUE", TYPES, "HIGH", "is_active", "is_active NOT IN ('true', 'false', '1', '0', 'yes', 'no')", "' has invalid is_active: ''', is_active, ''''"),
    _case("V22", "OUT OF RANGE", BUSINESS, "MEDIUM", "completion_rate", "completion_rate < 0 OR completion_rate > 100", "' has completion_rate outside 0-100%: ', completion_rate"),
    _case("V23", "INVALID PHONE FORMAT", TYPES, "HIGH", "phone", "NOT regexp_full_match(digits, '[0-9]{7,15}')", "' has invalid phone number: ''', phone, ''''"),
    _case("V24", "INVALID ID FORMAT", TYPES, "HIGH", "customer_id", "length(customer_id::VARCHAR) < 2", "' has customer_id too short: ''', customer_id, ''''"),
    _case(
        "V25", "INVALID CATEGORY", BUSINESS, "MEDIUM", "department", "department = 'BUILDING'",
        "' has invalid department: ''', department, ''' (expected: HR, Finance, Engineering, Sales, Marketing, Operations, IT, Legal)'",
    ),
    _case("V26", "STATISTICAL ANOMALY", "statistical_anomalies", "MEDIUM", "salary", "salary > 1000000 OR salary < 15000", "' has unusual salary: ', salary"),
    _case("V26", "STATISTICAL ANOMALY", "statistical_anomalies", "MEDIUM", "age", "age > 100 OR age < 16", "' has unusual age: ', age::DOUBLE"),
)
ISSUES = f"WITH facts AS ({FACTS})\n{union_all(list(CASES))}"

KEYWORD = f"""SELECT record_id, rule, kind, CASE WHEN contains(m, 'future') THEN 'future_dates'
    WHEN contains(m, 'missing required field') OR contains(m, 'empty') THEN 'missing_required_fields'
    WHEN contains(m, 'email') AND (contains(m, 'mismatch') OR contains(m, 'name')) THEN 'cross_field_issues'
    WHEN contains(m, 'email') AND contains(m, 'format') THEN 'email_format_issues'
    WHEN contains(m, 'invalid format') OR contains(m, 'non-numeric') THEN 'data_type_violations'
    WHEN contains(m, 'age') THEN 'age_inconsistencies'
    WHEN contains(m, 'sequence') OR contains(m, 'order') THEN 'impossible_sequences'
    WHEN contains(m, 'impossible value') OR contains(m, 'unrealistic value') THEN 'business_logic_issues'
    WHEN contains(m, 'statistical') OR contains(m, 'outlier') THEN 'statistical_anomalies'
    ELSE 'logical_inconsistencies' END AS category,
  CASE WHEN regexp_matches(m, 'critical|missing required field|impossible value|referential integrity') THEN 'CRITICAL'
    WHEN regexp_matches(m, 'invalid format|business logic|unrealistic value|format error') THEN 'HIGH'
    WHEN regexp_matches(m, 'mismatch|inconsistency|outlier') THEN 'MEDIUM' ELSE 'LOW' END AS severity, field, message
FROM (SELECT *, lower(message) AS m FROM ({ISSUES}))"""


def _issues(spark, sf_dir, mode="structured"):
    return rules.record_issues(derived(spark, sf_dir, PEOPLE), AS_OF, row_index=F.col("customer_id"), mode=mode)


WITHOUT_NUMBERS = "rule NOT IN ('V10', 'V22', 'V26')"


@check("rules_issues", f"SELECT record_id, rule, kind, category, severity, field FROM ({ISSUES})")
def rules_issues(spark, sf_dir):
    return _issues(spark, sf_dir).drop("message")


@check("rules_messages", f"SELECT record_id, rule, message FROM ({ISSUES}) WHERE {WITHOUT_NUMBERS}")
def rules_messages(spark, sf_dir):
    # Texts with doubles differ in how the engines spell them.
    return _issues(spark, sf_dir).where(WITHOUT_NUMBERS).select("record_id", "rule", "message")


@check("rules_keyword_mode", f"SELECT record_id, rule, category, severity, field FROM ({KEYWORD})")
def rules_keyword_mode(spark, sf_dir):
    return _issues(spark, sf_dir, "keyword").select("record_id", "rule", "category", "severity", "field")


@check(
    "issue_categories",
    f"""SELECT category, count(*) AS n FROM (SELECT category FROM ({ISSUES})
UNION ALL SELECT 'temporal_issues' FROM ({ISSUES}) WHERE category = 'future_dates') GROUP BY 1""",
)
def issue_categories(spark, sf_dir):
    return I.category_counts(_issues(spark, sf_dir))


def _severity_sql(source: str) -> str:
    return "SELECT " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in I.SEVERITIES) + f" FROM ({source})"


@check("issue_severities", _severity_sql(ISSUES))
def issue_severities(spark, sf_dir):
    return I.severity_counts(_issues(spark, sf_dir))


@check("issue_severities_keyword", _severity_sql(KEYWORD))
def issue_severities_keyword(spark, sf_dir):
    return I.severity_counts(_issues(spark, sf_dir, "keyword"))


def _rate(name: str, *categories: str) -> str:
    listed = ", ".join(f"'{c}'" for c in categories)
    return f"round(greatest(0, (max(n) - count(*) FILTER (WHERE category IN ({listed}))) * 100.0 / max(n)), 6)::DOUBLE AS {name}"


def _rates_sql(source: str) -> str:
    return f"""SELECT {_rate('completeness_rate', MISSING)}, {_rate('validity_rate', TYPES, 'email_format_issues')},
  {_rate('consistency_rate', 'cross_field_issues', 'age_inconsistencies')}, {_rate('business_rule_compliance_rate', BUSINESS)}
FROM ({source}), (SELECT count(*) AS n FROM customer)"""


@check("validation_rates", _rates_sql(ISSUES))
def validation_rates(spark, sf_dir):
    found = I.validation_rates(_issues(spark, sf_dir), table(spark, sf_dir, "customer"))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@check("validation_rates_keyword", _rates_sql(KEYWORD))
def validation_rates_keyword(spark, sf_dir):
    found = I.validation_rates(_issues(spark, sf_dir, "keyword"), table(spark, sf_dir, "customer"))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def _count(*categories: str) -> str:
    return f"count(*) FILTER (WHERE category IN ({', '.join(repr(c) for c in categories)}))"


def _counts_sql(source: str, keyword: bool) -> str:
    def kind(name: str) -> str:
        if keyword:
            return f"count(*) FILTER (WHERE category = '{BUSINESS}' AND contains(message, '{name}'))"
        return f"count(*) FILTER (WHERE kind = '{name}')"

    return f"""SELECT {_count('future_dates')} AS critical_issues, {_count('cross_field_issues', 'impossible_sequences')} AS major_issues,
  {_count('age_inconsistencies', 'email_format_issues')} AS minor_issues, {_count(BUSINESS)} AS business_issues,
  {kind('IMPOSSIBLE VALUE')} AS impossible_values, {kind('UNREALISTIC VALUE')} AS unrealistic_values,
  {kind('MISSING REQUIRED FIELD')} AS missing_required, {kind('INVALID FORMAT')} AS format_issues FROM ({source})"""


@check("score_issue_counts", _counts_sql(ISSUES, False))
def score_issue_counts(spark, sf_dir):
    return I.issue_counts(_issues(spark, sf_dir))


@check("score_issue_counts_keyword", _counts_sql(KEYWORD, True))
def score_issue_counts_keyword(spark, sf_dir):
    return I.issue_counts(_issues(spark, sf_dir, "keyword"), "keyword")


def _scores_sql(counts: str, original: float) -> str:
    return f"""SELECT *, CASE WHEN critical_issues > 0 THEN 'Not Ready' WHEN major_issues > 3 THEN 'Needs Review'
    WHEN quality_grade IN ('A', 'B') THEN 'Ready' WHEN quality_grade = 'C' THEN 'Needs Review' ELSE 'Not Ready' END AS production_readiness,
  CASE WHEN critical_issues > 0 THEN 'Critical' WHEN major_issues > 5 THEN 'High' WHEN major_issues > 0 THEN 'Medium' ELSE 'Low' END AS risk_level,
  round((completeness * 30 + validity * 25 + consistency * 25 + business_rule_compliance * 20) / 100, 2) AS weighted_score
FROM (SELECT * EXCLUDE (n, raw), total_issues * 0 + {original}::DOUBLE AS original_score,
    CASE WHEN critical_issues > 0 OR impossible_values > 0 THEN least(raw, 40) WHEN missing_required > 2 OR business_issues > 5 THEN least(raw, 50)
      WHEN major_issues > 5 OR business_issues > 2 THEN least(raw, 60) WHEN major_issues > 0 OR minor_issues > 5 OR business_issues > 0 THEN least(raw, 75)
      WHEN minor_issues > 0 THEN least(raw, 85) ELSE raw END::DOUBLE AS corrected_score,
    CASE WHEN critical_issues > 0 OR impossible_values > 0 THEN CASE WHEN critical_issues > 5 OR impossible_values > 3 THEN 'F' ELSE 'D' END
      WHEN missing_required > 2 OR business_issues > 5 THEN 'D'
      WHEN major_issues > 5 OR business_issues > 2 THEN CASE WHEN business_issues > 3 THEN 'D' ELSE 'C' END
      WHEN major_issues > 0 OR minor_issues > 5 OR business_issues > 0 THEN 'C' WHEN minor_issues > 0 THEN 'B'
      WHEN raw >= 90 THEN 'A' ELSE 'B' END AS quality_grade,
    round(total_issues * 100.0 / n, 2) AS error_rate,
    round(greatest(0, 80 - missing_required * 100.0 / n * 2), 1)::DOUBLE AS completeness,
    round(greatest(0, 85 - format_issues * 100.0 / n * 3), 1)::DOUBLE AS validity,
    round(greatest(0, 80 - major_issues * 100.0 / n * 4), 1)::DOUBLE AS consistency,
    round(greatest(0, 75 - (business_issues + impossible_values * 2 + unrealistic_values) * 100.0 / n * 5), 1)::DOUBLE AS business_rule_compliance
  FROM (SELECT *, greatest(0, {original} - total_penalty) AS raw FROM (
    SELECT *, critical_issues + major_issues + minor_issues + business_issues AS total_issues,
      critical_issues * 25 + major_issues * 15 + minor_issues * 8 + business_issues * 18 + impossible_values * 20 + missing_required * 15 AS total_penalty
    FROM ({counts}), (SELECT count(*) AS n FROM customer))))"""


def _scored(spark, sf_dir, issues, mode, original):
    return I.corrected_scores(I.issue_counts(issues, mode), original, table(spark, sf_dir, "customer").count())


@check("score_corrected", _scores_sql(_counts_sql(ISSUES, False), 88.5))
def score_corrected(spark, sf_dir):
    return _scored(spark, sf_dir, _issues(spark, sf_dir), "structured", 88.5)


@check("score_corrected_keyword", _scores_sql(_counts_sql(KEYWORD, True), 88.5))
def score_corrected_keyword(spark, sf_dir):
    return _scored(spark, sf_dir, _issues(spark, sf_dir, "keyword"), "keyword", 88.5)


# One rule at a time reaches every step of the grade ladder.
LADDER = ("V02", "V06", "V07", "V08", "V11", "V23", "V25")


@check(
    "score_ladder",
    union_all(
        [f"SELECT '{r}' AS rule, * FROM ({_scores_sql(_counts_sql(f'''SELECT * FROM ({ISSUES}) WHERE rule = '{r}' ''', False), 95.0)})" for r in LADDER]
    ),
)
def score_ladder(spark, sf_dir):
    issues = _issues(spark, sf_dir)
    parts = [
        _scored(spark, sf_dir, issues.where(F.col("rule") == r), "structured", 95.0).select(F.lit(r).alias("rule"), "*")
        for r in LADDER
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@check(
    "violations",
    f"""SELECT rule, field, sum(n)::BIGINT AS violation_count, count(*) AS affected_records,
  array_to_string(list_sort(list(record_id ORDER BY record_id)[1:3]), ',') AS sample_records
FROM (SELECT rule, field, record_id, count(*) AS n FROM ({ISSUES}) GROUP BY ALL) GROUP BY 1, 2""",
)
def violations(spark, sf_dir):
    return I.violation_table(_issues(spark, sf_dir))


@check(
    "field_scorecard",
    f"""WITH i AS ({ISSUES}), c AS (SELECT field, {_count(TYPES, 'email_format_issues')} AS f,
    {_count('cross_field_issues', 'impossible_sequences', 'age_inconsistencies')} AS c,
    {_count(BUSINESS, 'future_dates', 'statistical_anomalies')} AS b FROM i GROUP BY 1),
  p AS ({union_all([f"SELECT '{n}' AS attribute, count(*) AS n, count(nullif({n}::VARCHAR, '')) AS present, count(DISTINCT nullif({n}::VARCHAR, '')) AS u FROM ({PEOPLE})" for n in ("name", "email", "age", "salary", "signup_date", "phone", "department")])})
SELECT *, round((completeness_rate * 30 + validity_rate * 25 + consistency_rate * 25 + business_rule_compliance * 20) / 100, 2)::DOUBLE AS quality_score FROM (
  SELECT 'people' AS table_name, attribute, round(100 - round((n - present) * 100.0 / n, 2), 2)::DOUBLE AS completeness_rate,
    round(greatest(0, (n - coalesce(f, 0)) * 100.0 / n), 2)::DOUBLE AS validity_rate, round(greatest(0, (n - coalesce(c, 0)) * 100.0 / n), 2)::DOUBLE AS consistency_rate,
    round(greatest(0, (n - coalesce(b, 0)) * 100.0 / n), 2)::DOUBLE AS business_rule_compliance, round(round(u * 1.0 / present, 3) * 100, 2)::DOUBLE AS uniqueness
  FROM p LEFT JOIN c ON attribute = field)""",
)
def field_scorecard(spark, sf_dir):
    people = derived(spark, sf_dir, PEOPLE).select(
        "customer_id", "name", "email", "age", "salary", "signup_date", "phone", "department"
    )
    card = I.field_scorecard(profile(people, "people"), _issues(spark, sf_dir))
    return card.where("attribute <> 'customer_id'")


@check(
    "metric_threshold",
    union_all(
        [
            f"SELECT '{m}' AS metric, round(avg(CASE WHEN {c} THEN 100.0 ELSE 0 END), 4)::DOUBLE AS value, {t}::DOUBLE AS threshold, "
            f"avg(CASE WHEN {c} THEN 100.0 ELSE 0 END) >= {t} AS passed FROM lineitem"
            for m, c, t in (
                ("positive quantity", "l_quantity > 0", 100.0), ("small discount", "l_discount <= 0.05", 80.0),
                ("open lines", "l_linestatus = 'O'", 40.0),
            )
        ]
    ),
)
def metric_threshold(spark, sf_dir):
    metrics = {
        "positive quantity": (F.col("l_quantity") > 0, 100.0),
        "small discount": (F.col("l_discount") <= 0.05, 80.0),
        "open lines": (F.col("l_linestatus") == "O", 40.0),
    }
    return I.metric_thresholds(table(spark, sf_dir, "lineitem"), metrics)


@check(
    "table_quality",
    f"""SELECT 'people' AS table_name, n AS total_records, corrected_score, completeness, validity, consistency, business_rule_compliance, quality_grade
FROM ({_scores_sql(_counts_sql(ISSUES, False), 88.5)}), (SELECT count(*) AS n FROM customer)""",
)
def table_quality(spark, sf_dir):
    people = derived(spark, sf_dir, PEOPLE)
    scored = _scored(spark, sf_dir, _issues(spark, sf_dir), "structured", 88.5).withColumn("table_name", F.lit("people"))
    return I.table_quality(table_scores(profile(people.select("customer_id", "age"), "people")), scored)


# --- field resolution, dates, numbers ------------------------------------------------------------------------------------


@check(
    "field_resolution",
    """SELECT concat('Record_', c_custkey) AS record_id, c_name AS name, concat('c', c_custkey, '@corp.org') AS email,
  (c_custkey % 90)::BIGINT AS age, '2020-01-02' AS signup_date, '2021-05-06,2021-07-08' AS purchases FROM customer""",
)
def field_resolution(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("user"),
        F.lit(None).cast("string").alias("email"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@corp.org")).alias("work_email"),
        F.lit("unknown").alias("age"),
        (F.col("c_custkey") % 90).alias("user_age"),
        F.lit(None).cast("string").alias("signup_date"),
        F.lit("2020-01-02").alias("join_date"),
        F.array(F.lit("2021-05-06"), F.lit(None)).alias("purchase_dates"),
        F.lit("2021-07-08").alias("order_date"),
    )
    return df.select(
        rules.record_id(df, row_index=F.col("c_custkey")).alias("record_id"),
        rules.record_name(df).alias("name"),
        rules.record_email(df).alias("email"),
        rules.record_age(df).alias("age"),
        rules.signup_date(df).alias("signup_date"),
        F.array_join(rules.purchase_dates(df), ",").alias("purchases"),
    )


SPARK_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd-MM-yyyy")


@check(
    "date_parsing",
    union_all([f"SELECT event_id, '{s.replace(chr(39), '')}' AS form, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, true AS is_format FROM events" for s in SPARK_FORMS]),
)
def date_parsing(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    result = None
    for form in SPARK_FORMS:
        text = F.date_format("ts", form)
        part = events.select(
            "event_id",
            F.lit(form.replace("'", "")).alias("form"),
            dates.parse_date(text).cast("string").alias("day"),
            dates.is_date_format(text).alias("is_format"),
        )
        result = part if result is None else result.unionByName(part)
    return result


@check(
    "number_sniffing",
    """SELECT event_id, round(value, 4) AS plain, round(value * 1000, 4) AS exponent, event_id::DOUBLE AS padded, NULL::DOUBLE AS suffixed FROM events""",
)
def number_sniffing(spark, sf_dir):
    value = F.col("value").cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(numbers.to_number(value), 4).alias("plain"),
        F.round(numbers.to_number(F.concat(value, F.lit("e3"))), 4).alias("exponent"),
        numbers.to_number(F.concat(F.lit(" +"), F.col("event_id").cast("string"), F.lit(". "))).alias("padded"),
        numbers.to_number(F.concat(value, F.lit("d"))).alias("suffixed"),
    )


@check(
    "rules_orders",
    """SELECT rule, field, count(*) AS n FROM (
  SELECT 'V19' AS rule, 'customer_id' AS field FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'V24', 'customer_id' FROM orders WHERE o_orderkey % 3 <> 0 AND length(o_custkey::VARCHAR) < 2
  UNION ALL SELECT 'V11', 'name' FROM orders) GROUP BY 1, 2""",
)
def rules_orders(spark, sf_dir):
    found = rules.record_issues(derived(spark, sf_dir, ORDERS_WITH_NULLS), AS_OF, row_index=F.col("o_orderkey"))
    return found.groupBy("rule", "field").agg(F.count("*").alias("n"))


# --- rules that look at other rows --------------------------------------------------------------------------------------

# Orders whose ids repeat now and then, with totals of parts and of lines, some of them off.
INVOICES = """
SELECT CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey - 1 WHEN o_orderkey % 33 = 5 THEN NULL ELSE o_orderkey END AS invoice_id, o_orderkey,
       CAST(floor(o_totalprice) AS BIGINT) AS subtotal, CAST(o_orderkey % 90 AS BIGINT) AS tax,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS BIGINT) ELSE 5 END AS shipping, CAST(o_orderkey % 3 AS BIGINT) AS discount,
       CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 90 + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 5 END - o_orderkey % 3
         + CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END AS total,
       CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS pieces_known
FROM orders
"""
PIECES = "SELECT l_orderkey, sum(l_quantity) AS pieces FROM lineitem GROUP BY l_orderkey"


def _invoices_sql() -> str:
    who = "coalesce(o_orderkey::VARCHAR, '') AS record_id"
    fixed = "'business_logic_issues' AS category, 'CRITICAL' AS severity"
    return f"""WITH inv AS (SELECT i.*, CASE WHEN pieces_known = 1 THEN coalesce(pieces, 0) ELSE coalesce(pieces, 0) + 3 END AS n_pieces, coalesce(pieces, 0) AS pieces
    FROM ({INVOICES}) i LEFT JOIN ({PIECES}) p ON p.l_orderkey = i.o_orderkey),
  copies AS (SELECT invoice_id, count(*) AS n FROM inv WHERE invoice_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT concat('Record_', o_orderkey) AS record_id, 'V28' AS rule, 'DUPLICATE ID' AS kind, {fixed}, 'invoice_id' AS field, invoice_id::VARCHAR AS actual, 'a value of its own' AS expected
FROM inv JOIN copies USING (invoice_id)
UNION ALL
SELECT concat('Record_', o_orderkey), 'V27', 'CALCULATION ERROR', {fixed}, 'total', total::VARCHAR, (subtotal + tax + coalesce(shipping, 0) - discount)::DOUBLE::VARCHAR
FROM inv WHERE abs(total - (subtotal + tax + coalesce(shipping, 0) - discount)) > 0.01
UNION ALL
SELECT concat('Record_', o_orderkey), 'V27', 'CALCULATION ERROR', {fixed}, 'n_pieces', n_pieces::DOUBLE::VARCHAR, pieces::DOUBLE::VARCHAR FROM inv WHERE pieces_known = 0"""


def _invoice_issues(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    pieces = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("double").alias("pieces"))
    off = F.when(F.col("pieces_known") == 1, 0.0).otherwise(3.0)
    invoices = derived(spark, sf_dir, INVOICES).join(pieces, "o_orderkey", "left").withColumn("n_pieces", F.coalesce("pieces", F.lit(0.0)) + off).drop("pieces", "pieces_known")
    declared = rules.RuleSet(
        unique=("invoice_id",),
        sums=(rules.ComponentSum("total", ("subtotal", "tax", "shipping"), ("discount",)), rules.LineSum("n_pieces", "o_orderkey", lines, "l_orderkey", F.col("l_quantity"))),
    )
    return rules.record_issues(invoices, AS_OF, declared, row_index=F.col("o_orderkey"), values=True).where("rule IN ('V27', 'V28')")


@check("rules_table_wide", _invoices_sql())
def rules_table_wide(spark, sf_dir):
    return _invoice_issues(spark, sf_dir).drop("message")


@check(
    "score_table_wide",
    f"""SELECT 0::BIGINT AS critical_issues, 0::BIGINT AS major_issues, 0::BIGINT AS minor_issues, count(*) AS business_issues, 0::BIGINT AS impossible_values,
  0::BIGINT AS unrealistic_values, 0::BIGINT AS missing_required, 0::BIGINT AS format_issues FROM ({_invoices_sql()})""",
)
def score_table_wide(spark, sf_dir):
    return I.issue_counts(_invoice_issues(spark, sf_dir))


@check(
    "violation_details",
    f"""SELECT 'invoices' AS table_name, rule, kind, severity, field, count(*) AS violation_count, count(DISTINCT record_id) AS affected_records,
  array_to_string(list(record_id ORDER BY record_id, actual, expected)[1:3], ',') AS sample_records,
  array_to_string(list(actual ORDER BY record_id, actual, expected)[1:3], ',') AS current_values,
  array_to_string(list(expected ORDER BY record_id, actual, expected)[1:3], ',') AS expected_values
FROM ({_invoices_sql()}) GROUP BY ALL""",
)
def violation_details(spark, sf_dir):
    found = I.violation_details(_invoice_issues(spark, sf_dir), "invoices")
    return found.withColumns({c: F.array_join(c, ",") for c in ("sample_records", "current_values", "expected_values")})


# --- a rule set of the caller's -------------------------------------------------------------------------------------------


@check(
    "rules_own_set",
    """SELECT concat('Record_', c_custkey) AS record_id, 'V25' AS rule, 'INVALID CATEGORY' AS kind, 'c_mktsegment' AS field FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT concat('Record_', c_custkey), 'V26', 'STATISTICAL ANOMALY', 'c_acctbal' FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000
UNION ALL SELECT concat('Record_', c_custkey), 'X01', 'OWN RULE', 'c_nationkey' FROM customer WHERE c_nationkey % 2 = 1""",
)
def rules_own_set(spark, sf_dir):
    """Categories and bounds of other fields, and a rule that the caller writes as a condition."""

    def odd_nation(k: rules.Checks) -> None:
        nation = F.col("c_nationkey")
        k.add((nation % 2 == 1, k.issue("X01", "OWN RULE", "business_logic_issues", "LOW", "c_nationkey", " has odd nation ", nation)))

    own = rules.RuleSet(categories={"c_mktsegment": ("BUILDING", "MACHINERY")}, statistical_bounds={"c_acctbal": (0, 5000)}, extra=(odd_nation,))
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    found = rules.record_issues(df, AS_OF, own, row_index=F.col("c_custkey"))
    return found.where("rule IN ('V25', 'V26', 'X01')").select("record_id", "rule", "kind", "field")
