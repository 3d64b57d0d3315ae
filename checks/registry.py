"""Registry of queries and their SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def check(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is left out where SQL has no equivalent."""

    def register(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), d) for n, d in digits.items()})


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# --- derived tables, the same SQL in Spark and in the check -------------------------------------------------------

PEOPLE = """
SELECT
  c_custkey AS customer_id,
  CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN 'test'
       ELSE concat('Ann', chr(CAST(97 + c_custkey % 26 AS INT)), ' Lee') END AS name,
  CASE WHEN c_custkey % 11 = 0 THEN 'not-an-email' WHEN c_custkey % 13 = 0 THEN 'ann@example.com'
       WHEN c_custkey % 7 = 0 THEN 'zed.kim@corp.org'
       ELSE concat('ann', chr(CAST(97 + c_custkey % 26 AS INT)), '.lee@corp.org') END AS email,
  CAST(c_custkey % 170 - 5 AS INT) AS age,
  CASE WHEN c_custkey % 19 = 0 THEN CAST(NULL AS DOUBLE) ELSE c_acctbal * 20 END AS salary,
  CASE WHEN c_custkey % 29 = 0 THEN 'invalid-date'
       ELSE concat('20', lpad(CAST(10 + c_custkey % 20 AS VARCHAR(2)), 2, '0'), '-',
                   lpad(CAST(1 + c_custkey % 12 AS VARCHAR(2)), 2, '0'), '-',
                   lpad(CAST(1 + c_custkey % 28 AS VARCHAR(2)), 2, '0')) END AS signup_date,
  concat('20', lpad(CAST(10 + c_custkey % 18 AS VARCHAR(2)), 2, '0'), '-06-15') AS last_login,
  concat('20', lpad(CAST(8 + c_custkey % 22 AS VARCHAR(2)), 2, '0'), '/03/04') AS order_date,
  CASE WHEN c_custkey % 31 = 0 THEN 'maybe' WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS is_active,
  CASE WHEN c_custkey % 37 = 0 THEN '12-34' ELSE '+1 (555) 010-0199' END AS phone,
  CASE WHEN c_custkey % 5 = 0 THEN 'BUILDING' ELSE 'Sales' END AS department,
  CAST(c_custkey % 130 - 10 AS DOUBLE) AS completion_rate
FROM customer
"""

# Orders with nulls and blanks sown in: every row of orders is kept.
ORDERS_WITH_NULLS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS customer_id,
       CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
FROM orders
"""

# Event ids as a mix of words, whole numbers and decimals.
MIXED = """
SELECT event_id AS ord,
       CASE WHEN event_id % 4 = 0 THEN 'n/a' WHEN event_id % 4 = 1 THEN CAST(event_id AS varchar(20))
            ELSE concat(CAST(event_id AS varchar(20)), '.5') END AS v
FROM events
"""

DAILY = "SELECT CAST(ts AS date) AS d, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1"


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs one of the derived tables above; the base table is named in its FROM clause."""
    for name in ("customer", "orders", "events"):
        if f"FROM {name}" in sql:
            sql = sql.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(sql)
