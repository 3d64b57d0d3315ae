"""Numeric sniffing of strings, by the grammar of a Python float literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"\d+(?:_\d+)*"
FLOAT_GRAMMAR = (
    rf"(?i)^\s*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)\s*$"
)


def is_number(c: Column) -> Column:
    return c.rlike(FLOAT_GRAMMAR)


def to_number(c: Column) -> Column:
    """The number a string spells, or null. Underscores between digits are allowed, type suffixes are not."""
    return F.when(is_number(c), spelled_number(c))


def spelled_number(c: Column) -> Column:
    """The number of a string already known to spell one."""
    return F.regexp_replace(c, r"[_\s]", "").try_cast("double")


def value_tag(c: Column, number: Column | None = None) -> Column:
    """Type vote of one string: ``integer``, ``float`` or ``string``; null for null and empty.

    ``number`` hands in the result of ``is_number`` where it is at hand.
    """
    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
        .when(~(is_number(c) if number is None else number), "string")
        .when(c.contains("."), "float")
        .otherwise("integer")
    )
