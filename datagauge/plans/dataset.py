"""Profiles, scores and reports of a whole dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datagauge.operators import tables as tables_ops
from datagauge.operators.issues import corrected_scores, issue_counts
from datagauge.operators.ordering import with_row_index
from datagauge.operators.profile import profile_all
from datagauge.operators.records import profile_variant
from datagauge.operators.rules import DEFAULT_RULES, RuleSet, record_issues
from datagauge.params import DEFAULTS, Thresholds
from datagauge.session import cut_lineage
from datagauge.sources import files, nested

from .reports import column_report, scorecard, scorecard_rows


def table_positions(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``(table_name, position)`` in the given order."""
    return spark.createDataFrame(list(zip(names, range(len(names)))), "table_name string, position int")


@dataclass
class Assessment:
    """Frames of a dataset run; each holds a few rows per column or table."""

    profiles: DataFrame
    table_scores: DataFrame
    summary: DataFrame
    top_issues: DataFrame
    scorecards: DataFrame
    corrected: dict[str, DataFrame]


def assess(
    tables: dict[str, DataFrame],
    as_of_date: str,
    rules: RuleSet = DEFAULT_RULES,
    limits: Thresholds = DEFAULTS,
    order_by: dict[str, Sequence[str]] | None = None,
) -> Assessment:
    """Profiles every table, validates every record and scores the result.

    The profile rows are checkpointed, since all that follows reads them. ``order_by`` names a total order for tables
    whose records have no id: their positions in it stand in the issues, the same in every run.
    """
    profiles = cut_lineage(profile_all(tables, limits=limits, as_of_date=as_of_date))
    scores = tables_ops.table_scores(profiles)
    originals = {r.table_name: r for r in scores.collect()}
    corrected = {}
    for name, df in tables.items():
        index = None
        if order_by and name in order_by:
            df, index = with_row_index(df, order_by[name], "_row_index"), F.col("_row_index")
        counts = issue_counts(record_issues(df, as_of_date, rules, index))
        corrected[name] = corrected_scores(counts, originals[name].data_quality_score, originals[name].total_records)
    return Assessment(
        profiles,
        scores,
        tables_ops.dataset_summary(profiles),
        tables_ops.top_issues(profiles),
        scorecard_rows(scorecard(profiles)),
        corrected,
    )


def assess_documents(df: DataFrame, column: str, limits: Thresholds = DEFAULTS) -> Assessment:
    """Profiles and scores all tables nested in a variant column of documents whose keys differ.

    Tables and attributes are data: one profile serves all of them, however many there are. Record rules look for named
    typed fields and are left to ``assess``, so ``corrected`` is empty.
    """
    rows = cut_lineage(nested.extract_variant_tables(df, column))
    profiles = cut_lineage(profile_variant(rows, "record", table_name="table_name", limits=limits))
    return Assessment(
        profiles, tables_ops.table_scores(profiles), tables_ops.dataset_summary(profiles), tables_ops.top_issues(profiles), scorecard_rows(scorecard(profiles)), {}
    )


def write_report(
    tables: dict[str, DataFrame], order_by: dict[str, Sequence[str]], out: str, as_of_date: str
) -> Assessment:
    """Writes per table the original, the column report and the scorecard as CSV, and the profiles as JSON."""
    result = assess(tables, as_of_date, order_by=order_by)
    for name, df in tables.items():
        folder = f"{out}/{nested.safe_name(name)}"
        own = result.profiles.where(result.profiles.table_name == name)
        files.write_csv(df, f"{folder}_original")
        files.write_csv(column_report(df, own, order_by[name]), f"{folder}_enriched_metadata_anomalies")
        rows = result.scorecards.where(result.scorecards.table_name == name).orderBy("position")
        files.write_csv(rows.drop("table_name", "position"), f"{folder}_quality_assessment")
    files.write_json(result.profiles, f"{out}/profiles")
    files.write_json(result.summary, f"{out}/summary")
    return result
