"""Whole-dataset runs: profile every table, score, validate and write the report tables."""
