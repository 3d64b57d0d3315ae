"""Profiling, statistics, key, rule and scoring operators."""
