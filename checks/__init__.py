"""Queries over the given tables and the SQL that must give the same rows."""

from . import key_checks, profile_checks, report_checks, rule_checks, source_checks, stats_checks, table_checks
from .registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "key_checks", "profile_checks", "report_checks", "rule_checks", "source_checks",
    "stats_checks", "table_checks",
]
