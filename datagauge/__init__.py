"""Spark data profiling and data quality."""
