"""Queries next to their SQL on the smallest scale, and plan checks. ``check_oracles.py`` runs all of them."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import TABLES, rows

QUICK = (
    "distinct_counts", "top_values", "pattern_counts", "type_vote_mixed", "element_types_json", "object_keys",
    "outlier_rows_events", "percentiles_bracket", "correlation", "kolmogorov_distances", "autocorrelation",
    "change_points_days", "schema_analysis", "schema_presence", "completeness_people", "duplicates", "fk_candidates",
    "orphan_rows", "integrity_rate", "cardinality", "line_totals", "rules_issues", "rules_keyword_mode",
    "issue_categories", "score_corrected", "nested_words", "extract_json", "source_csv", "report_string_labels",
)


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    result = db.execute(oracle_sql()[name])
    expected = rows([c[0] for c in result.description], result.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert entry(spark).count() == 8


LARGE = (
    "distinct_counts", "top_values", "duplicates", "fk_candidates", "orphan_keys", "orphan_rows", "integrity_rate",
    "cardinality", "line_totals", "rules_issues", "nested_words", "correlation_wide", "outlier_rows_events",
    "completeness_people", "schema_analysis", "element_types_json", "pattern_counts", "autocorrelation", "volatility",
)


@pytest.mark.parametrize("name", LARGE)
def test_plans_hold_no_product_of_tables(spark, sf_dir, name):
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ("autocorrelation", "volatility", "change_points", "kolmogorov_distances"))
def test_windows_have_a_partition(spark, sf_dir, name):
    """No window runs over a whole table in one task."""
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "_pid" in line or "chunk" in line or "slot" in line


def test_bounds_reach_the_scan(spark, sf_dir):
    plan = queries()["orphan_keys"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint>" in plan and "ReadSchema: struct<user_id:bigint>" in plan
