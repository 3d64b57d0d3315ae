"""Checks of keys, relationships and metadata rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datagauge.operators import keys, relations
from datagauge.operators.profile import metadata_all
from datagauge.plans.dataset import table_positions

from .profile_checks import COLUMNS
from .registry import ORDERS_WITH_NULLS, PEOPLE, STAR, check, derived, rounded, table, tables, union_all


def _is_key(name: str) -> bool:
    return "key" in name.lower()


KEYS = [(t, p, c) for p, t in enumerate(STAR) for c in COLUMNS[t] if _is_key(c)]


def overlap_sql(slots: list[tuple[str, int, str]]) -> str:
    parts = []
    for t1, p1, c1 in slots:
        for t2, p2, c2 in slots:
            if p1 < p2 and c1 != c2:
                parts.append(
                    f"""SELECT '{t1}' AS source_table, '{c1}' AS source_field, '{t2}' AS target_table, '{c2}' AS target_field,
  (SELECT count(*) FROM (SELECT {c1} FROM {t1} WHERE {c1} <> 0 INTERSECT SELECT {c2} FROM {t2} WHERE {c2} <> 0)) AS matching_values,
  greatest((SELECT count(DISTINCT {c1}) FROM {t1} WHERE {c1} <> 0), (SELECT count(DISTINCT {c2}) FROM {t2} WHERE {c2} <> 0)) AS largest"""
                )
    return f"""SELECT source_table, source_field, target_table, target_field, matching_values,
  round(matching_values * 1.0 / largest, 6) AS confidence FROM ({union_all(parts)}) WHERE matching_values > 0"""


@check("fk_candidates", overlap_sql(KEYS))
def fk_candidates(spark, sf_dir):
    return rounded(keys.fk_candidates(tables(spark, sf_dir, *STAR), _is_key), {"confidence": 6})


ID_TABLES = ("events", "documents", "labels", "embeddings", "pages", "conversations", "benchmark")
ID_SLOTS = [
    ("events", 0, "event_id"), ("events", 0, "user_id"), ("documents", 1, "doc_id"), ("labels", 2, "doc_id"),
    ("embeddings", 3, "vec_id"), ("pages", 4, "page_id"), ("conversations", 5, "conv_id"), ("benchmark", 6, "item_id"),
]


@check("fk_candidates_ids", overlap_sql(ID_SLOTS))
def fk_candidates_ids(spark, sf_dir):
    return rounded(keys.fk_candidates(tables(spark, sf_dir, *ID_TABLES), lambda n: n.endswith("_id")), {"confidence": 6})


@check(
    "fk_candidates_mixed_types",
    f"""SELECT 'customer' AS source_table, 'c_custkey' AS source_field, 'v' AS target_table, 'customer_id' AS target_field,
  (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey <> 0 INTERSECT SELECT customer_id FROM ({ORDERS_WITH_NULLS}) WHERE customer_id <> 0)) AS matching_values,
  round((SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey <> 0 INTERSECT SELECT customer_id FROM ({ORDERS_WITH_NULLS}) WHERE customer_id <> 0)) * 1.0
    / greatest((SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey <> 0), (SELECT count(DISTINCT customer_id) FROM ({ORDERS_WITH_NULLS}) WHERE customer_id <> 0)), 6) AS confidence""",
)
def fk_candidates_mixed_types(spark, sf_dir):
    orders = derived(spark, sf_dir, ORDERS_WITH_NULLS).select(F.col("customer_id").cast("double"), "o_orderstatus")
    found = keys.fk_candidates(
        {"customer": table(spark, sf_dir, "customer"), "v": orders},
        lambda n: n in ("c_custkey", "c_mktsegment", "customer_id", "o_orderstatus"),
    )
    return rounded(found, {"confidence": 6})


COMMON = [(t, p, c) for p, (t, cs) in enumerate(
    {"documents": ("doc_id", "text", "lang", "source", "n_chars"), "labels": ("doc_id", "quality", "toxic"),
     "benchmark": ("item_id", "text"), "conversations": ("conv_id", "turn", "role", "text"),
     "embeddings": ("vec_id", "embedding", "label")}.items()) for c in cs]


@check(
    "common_attributes",
    union_all(
        [
            f"""SELECT '{t1}' AS table1, '{t2}' AS table2, '{c}' AS attribute, (SELECT count({c}) FROM {t1}) AS present1, (SELECT count({c}) FROM {t2}) AS present2"""
            for t1, p1, c in COMMON
            for t2, p2, other in COMMON
            if c == other and p1 < p2
        ]
    ),
)
def common_attributes(spark, sf_dir):
    """Shared columns with the number of values that either table has in them."""
    named = tables(spark, sf_dir, *dict.fromkeys(t for t, _, _ in COMMON))
    counted = [
        df.agg(*[F.count(c).alias(c) for c in df.columns]).select(F.lit(t).alias("t"), F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("c", "n"))
        for t, df in named.items()
    ]
    present = reduce(DataFrame.unionByName, counted)
    first = present.select(F.col("t").alias("table1"), F.col("c").alias("attribute"), F.col("n").alias("present1"))
    second = present.select(F.col("t").alias("table2"), F.col("c").alias("attribute"), F.col("n").alias("present2"))
    return keys.common_attributes(named).join(first, ["table1", "attribute"]).join(second, ["table2", "attribute"])


@check(
    "cross_table_summary",
    f"""SELECT concat(source_table, '__', target_table) AS table_pair, 0::BIGINT AS common_attributes,
  count(*) AS foreign_key_candidates, round(max(confidence), 6) AS best_confidence FROM ({overlap_sql(KEYS)}) GROUP BY 1""",
)
def cross_table_summary(spark, sf_dir):
    return rounded(keys.cross_table_summary(tables(spark, sf_dir, *STAR), _is_key), {"best_confidence": 6})


# child, child key, parent, parent key
PAIRS = (
    ("documents", "doc_id", "labels", "doc_id"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("events", "user_id", "customer", "c_custkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_custkey", "orders", "o_custkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
)


@check("orphan_rows", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_rows(spark, sf_dir):
    child = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return keys.orphan_rows(child, "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@check(
    "orphan_keys",
    "SELECT c_custkey AS key, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1",
)
def orphan_keys(spark, sf_dir):
    return keys.orphan_keys(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "events"), "user_id")


@check(
    "orphan_keys_hot",
    "SELECT source AS key, count(*) AS n FROM documents WHERE source NOT IN (SELECT role FROM conversations) GROUP BY 1",
)
def orphan_keys_hot(spark, sf_dir):
    return keys.orphan_keys(table(spark, sf_dir, "documents"), "source", table(spark, sf_dir, "conversations"), "role")


def integrity_sql(child: str, key: str, parent: str, parent_key: str) -> str:
    return f"""SELECT '{child}.{key}' AS child, '{parent}.{parent_key}' AS parent, count(*) AS child_rows,
  count(*) FILTER (WHERE p.k IS NOT NULL) AS matched_rows, count(DISTINCT CASE WHEN p.k IS NULL THEN c.{key} END) AS orphan_keys,
  round(count(*) FILTER (WHERE p.k IS NOT NULL) * 100.0 / count(*), 4) AS integrity_rate
FROM {child} c LEFT JOIN (SELECT DISTINCT {parent_key} AS k FROM {parent}) p ON c.{key} = p.k WHERE c.{key} IS NOT NULL"""


def _over_pairs(spark, sf_dir, operator):
    result = None
    for child, key, parent, parent_key in PAIRS:
        found = operator(table(spark, sf_dir, child), key, table(spark, sf_dir, parent), parent_key).select(
            F.lit(f"{child}.{key}").alias("child"), F.lit(f"{parent}.{parent_key}").alias("parent"), "*"
        )
        result = found if result is None else result.unionByName(found)
    return result


@check("integrity_rate", union_all([integrity_sql(*p) for p in PAIRS]))
def integrity_rate(spark, sf_dir):
    return _over_pairs(spark, sf_dir, keys.integrity_rate)


def cardinality_sql(child: str, key: str, parent: str, parent_key: str) -> str:
    return f"""SELECT '{child}.{key}' AS child, '{parent}.{parent_key}' AS parent, count(*) AS parent_keys,
  min(children) AS min_children, max(children) AS max_children, round(avg(children), 4) AS avg_children,
  count(*) FILTER (WHERE children = 0) AS childless_parents,
  CASE WHEN max(children) > 1 AND max(parents) > 1 THEN 'n:m' WHEN max(children) > 1 THEN '1:n'
       WHEN max(parents) > 1 THEN 'n:1' ELSE '1:1' END AS cardinality
FROM (SELECT p.k, p.parents, coalesce(c.children, 0) AS children
      FROM (SELECT {parent_key} AS k, count(*) AS parents FROM {parent} WHERE {parent_key} IS NOT NULL GROUP BY 1) p
      LEFT JOIN (SELECT {key} AS k, count(*) AS children FROM {child} GROUP BY 1) c ON p.k = c.k)"""


@check("cardinality", union_all([cardinality_sql(*p) for p in PAIRS]))
def cardinality(spark, sf_dir):
    return _over_pairs(spark, sf_dir, keys.cardinality)


@check("duplicate_ids", "SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return keys.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


@check(
    "line_totals",
    """SELECT o_orderkey, round(o_totalprice, 2) AS actual, round(coalesce(s, 0), 2) AS expected, round(o_totalprice - coalesce(s, 0), 2) AS variance
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY 1)
  ON o_orderkey = l_orderkey WHERE abs(o_totalprice - coalesce(s, 0)) > 0.01""",
)
def line_totals(spark, sf_dir):
    amount = F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    found = keys.line_total_violations(
        table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", table(spark, sf_dir, "lineitem"), "l_orderkey", amount
    )
    return rounded(found, {"actual": 2, "expected": 2, "variance": 2})


CHARGES = """SELECT event_id, value AS subtotal, value / 8 AS tax, user_id / 4 AS shipping,
  CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS discount,
  value + value / 8 + user_id / 4 - CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS total FROM events"""


@check(
    "component_sums",
    f"""SELECT event_id AS key, round(total, 6) AS actual, round(subtotal + tax + shipping - discount, 6) AS expected,
  round(total - (subtotal + tax + shipping - discount), 6) AS variance
FROM ({CHARGES}) WHERE abs(total - (subtotal + tax + shipping - discount)) > 0.05""",
)
def component_sums(spark, sf_dir):
    df = derived(spark, sf_dir, CHARGES)
    found = keys.component_sum_violations(df, "event_id", "total", ["subtotal", "tax", "shipping"], ["discount"], 0.05)
    return rounded(found, {"actual": 6, "expected": 6, "variance": 6})


# --- metadata rules ------------------------------------------------------------------------------------------------------

POSITIONS = ", ".join(f"('{t}', {p})" for p, t in enumerate(STAR))
FIELDS = ", ".join(f"('{t}', {p}, '{c}', '{k}')" for p, t in enumerate(STAR) for c, k in COLUMNS[t].items())

PAIR_SQL = f"""SELECT a.t AS t1, a.c AS c1, a.k AS k1, b.t AS t2, b.c AS c2, b.k AS k2,
  replace(a.c, '_', '') AS n1, replace(b.c, '_', '') AS n2, a.k = b.k AS same
FROM (VALUES {FIELDS}) a(t, p, c, k) JOIN (VALUES {FIELDS}) b(t, p, c, k) ON a.p < b.p"""

LOOSE_PEOPLE = f"SELECT customer_id, name, email, age, signup_date, last_login, department FROM ({PEOPLE})"


def _profiles(spark, sf_dir):
    return metadata_all(tables(spark, sf_dir, *STAR)), table_positions(spark, STAR)


@check(
    "rel_candidates",
    f"""SELECT t2 AS parent_table, c2 AS parent_field, t1 AS child_table, c1 AS child_field,
  round(CASE WHEN c1 = c2 THEN 0.4 WHEN contains(c2, n1) OR contains(c1, n2) THEN 0.3 ELSE 0 END + 0.3
    + CASE WHEN c1 LIKE '%\\_id' ESCAPE '\\' OR c2 LIKE '%\\_id' ESCAPE '\\' THEN 0.2 ELSE 0 END, 6)::DOUBLE AS confidence
FROM ({PAIR_SQL}) WHERE same AND (contains(c2, n1) OR contains(c1, n2) OR c1 LIKE '%\\_id' ESCAPE '\\' OR c2 LIKE '%\\_id' ESCAPE '\\')""",
)
def rel_candidates(spark, sf_dir):
    return relations.relationship_candidates(*_profiles(spark, sf_dir))


MIXED_FIELDS = {
    "orders_v": {"o_orderkey": "integer", "customer_id": "integer", "o_orderstatus": "string", "o_totalprice": "float"},
    "labels": {"doc_id": "integer", "quality": "integer", "toxic": "integer"},
    "documents": {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"},
    "people": {
        "customer_id": "integer", "name": "string", "email": "string", "age": "integer", "signup_date": "string",
        "last_login": "string", "department": "string",
    },
    "orders": COLUMNS["orders"],
}
MIXED_VALUES = ", ".join(
    f"('{t}', {p}, '{c}', '{k}')" for p, t in enumerate(MIXED_FIELDS) for c, k in MIXED_FIELDS[t].items()
)
MIXED_PAIRS = PAIR_SQL.replace(FIELDS, MIXED_VALUES)
PARTS = ("id", "code", "number", "key", "ref", "date", "time")
SIMILAR = " OR ".join(
    ["contains(n1, n2) OR contains(n2, n1)"]
    + [f"(n1 LIKE '%{p}' AND n2 LIKE '%{p}') OR (n1 LIKE '{p}%' AND n2 LIKE '{p}%')" for p in PARTS]
)
ID_END = "(c1 LIKE '%\\_id' ESCAPE '\\' OR c2 LIKE '%\\_id' ESCAPE '\\')"
MIXED_CANDIDATES = f"""SELECT t2 AS parent_table, c2 AS parent_field, t1 AS child_table, c1 AS child_field,
  round(CASE WHEN c1 = c2 THEN 0.4 WHEN contains(c2, n1) OR contains(c1, n2) THEN 0.3 ELSE 0 END + 0.3
    + CASE WHEN {ID_END} THEN 0.2 ELSE 0 END, 6)::DOUBLE AS confidence
FROM ({MIXED_PAIRS}) WHERE same AND (contains(c2, n1) OR contains(c1, n2) OR {ID_END})"""


def _mixed(spark, sf_dir):
    found = {
        "orders_v": derived(spark, sf_dir, ORDERS_WITH_NULLS),
        "labels": table(spark, sf_dir, "labels"),
        "documents": table(spark, sf_dir, "documents"),
        "people": derived(spark, sf_dir, LOOSE_PEOPLE),
        "orders": table(spark, sf_dir, "orders"),
    }
    return metadata_all(found, as_of_date="2024-12-31"), table_positions(spark, list(found))


@check("rel_candidates_mixed", MIXED_CANDIDATES)
def rel_candidates_mixed(spark, sf_dir):
    return relations.relationship_candidates(*_mixed(spark, sf_dir))


@check(
    "rel_type_conflicts",
    f"""SELECT t1 AS table1, c1 AS field1, k1 AS type1, t2 AS table2, c2 AS field2, k2 AS type2
FROM ({MIXED_PAIRS}) WHERE NOT same AND (c1 = c2 OR {SIMILAR})""",
)
def rel_type_conflicts(spark, sf_dir):
    return relations.inconsistent_types(*_mixed(spark, sf_dir))


NULL_KEYS = """SELECT 'orders_v' AS table_name, 'customer_id' AS field, t.n AS table2,
  round(count(*) FILTER (WHERE o_orderkey % 3 = 0) * 100.0 / count(*), 2) AS null_percentage
FROM orders, (VALUES ('labels'), ('documents'), ('people'), ('orders')) t(n) GROUP BY t.n"""


@check("rel_nullable_keys", NULL_KEYS)
def rel_nullable_keys(spark, sf_dir):
    return relations.nullable_foreign_keys(*_mixed(spark, sf_dir))


@check(
    "rel_schema_evolution",
    f"""SELECT count(*) AS tables, max(n) AS most_fields, min(n) AS least_fields,
  (max(n) - min(n)) * 1.0 / max(n) > 0.5 AS schema_evolution_detected
FROM (SELECT t, count(*) AS n FROM (VALUES {FIELDS}) f(t, p, c, k) GROUP BY 1)""",
)
def rel_schema_evolution(spark, sf_dir):
    return relations.schema_evolution(_profiles(spark, sf_dir)[0])


@check(
    "rel_integrity_score",
    f"""SELECT r AS relationships, v AS violations, c AS inconsistencies, round(greatest(0, 100 - v * 100.0 / r), 2) AS referential_integrity_score
FROM (SELECT count(*) AS r FROM ({MIXED_CANDIDATES})), (SELECT count(*) AS v FROM ({NULL_KEYS})),
  (SELECT count(*) AS c FROM ({MIXED_PAIRS}) WHERE NOT same AND (c1 = c2 OR {SIMILAR}))""",
)
def rel_integrity_score(spark, sf_dir):
    return relations.integrity_score(*_mixed(spark, sf_dir))


RANGES = {(t, c): k for t in STAR for c, k in COLUMNS[t].items() if k in ("integer", "float")}


def _range_sql() -> str:
    parts = []
    for t, c in RANGES:
        test = f"max({c}) - min({c}) > 1000000"
        if "age" in c:
            test = f"min({c}) < 0 OR max({c}) > 150"
        elif any(p in c for p in ("price", "amount", "cost", "total")):
            test = f"min({c}) < 0"
        parts.append(
            f"SELECT 'Numeric Range Validation' AS rule, '{t}' AS table_name, '{c}' AS field, 'LOW' AS severity, "
            f"printf('Range: %.2f to %.2f', min({c})::DOUBLE, max({c})::DOUBLE) AS actual FROM {t} HAVING {test}"
        )
    reference = (
        "SELECT 'Customer-Order Relationship', 'orders', 'N/A', 'MEDIUM', 'No customer reference found'"
    )
    return union_all([*parts, reference])


@check("meta_rules_star", _range_sql())
def meta_rules_star(spark, sf_dir):
    return relations.business_rule_violations(_profiles(spark, sf_dir)[0])


def _mixed_rules_sql() -> str:
    nulls = "round(count(*) FILTER (WHERE o_orderkey % 3 = 0) * 100.0 / count(*), 2)"
    blanks = "round(count(*) FILTER (WHERE o_orderkey % 5 = 0) * 100.0 / count(*), 2)"
    email = "^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$"
    return union_all(
        [
            f"""SELECT 'Critical Field Completeness' AS rule, 'orders_v' AS table_name, '{f}' AS field, 'HIGH' AS severity,
  concat(printf('%.2f', {share}), '% null values') AS actual FROM orders HAVING {share} > 5"""
            for f, share in (("customer_id", nulls), ("o_orderstatus", blanks))
        ]
        + [
            f"""SELECT 'Email Format Validation', 'people', 'email', 'MEDIUM', concat(count(*), ' invalid email formats')
FROM ({PEOPLE}) WHERE NOT regexp_matches(email, '{email}') HAVING count(*) > 0""",
            f"""SELECT 'Numeric Range Validation', 'people', 'age', 'LOW', printf('Range: %.2f to %.2f', min(age)::DOUBLE, max(age)::DOUBLE)
FROM ({PEOPLE}) HAVING min(age) < 0 OR max(age) > 150""",
            """SELECT 'Numeric Range Validation', 'orders', 'o_orderkey', 'LOW', printf('Range: %.2f to %.2f', min(o_orderkey)::DOUBLE, max(o_orderkey)::DOUBLE)
FROM orders HAVING max(o_orderkey) - min(o_orderkey) > 1000000""",
        ]
    )


@check("meta_rules_mixed", _mixed_rules_sql())
def meta_rules_mixed(spark, sf_dir):
    return relations.business_rule_violations(_mixed(spark, sf_dir)[0])


@check(
    "meta_future_dates",
    union_all(
        [
            f"""SELECT 'Historical Date Validation' AS rule, '{t}' AS table_name, '{c}' AS field, 'MEDIUM' AS severity,
  concat(count(*), ' future dates found') AS actual FROM {t} WHERE CAST({c} AS DATE) > DATE '{day}' HAVING count(*) > 0"""
            for t, c, day in (("orders", "o_orderdate", "1997-06-30"), ("lineitem", "l_shipdate", "1997-06-30"))
        ]
    ),
)
def meta_future_dates(spark, sf_dir):
    profiles = metadata_all(tables(spark, sf_dir, "orders", "lineitem"), as_of_date="1997-06-30")
    return relations.business_rule_violations(profiles).where("rule = 'Historical Date Validation'")


