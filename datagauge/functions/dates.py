"""Date parsing and date format checks on strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col, families
from .text import matches, strip

# The accepted date formats of the format check.
DATE_FORMATS = (
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{4}/\d{2}/\d{2}$",
    r"^\d{2}/\d{2}/\d{4}$",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"^\d{2}-\d{2}-\d{4}$",
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
)

_YEAR_FIRST = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}"
_CLOCK = r"\s+(?:2[0-3]|[01]?\d):(?:[0-5]?\d):(?:6[01]|[0-5]?\d)"


def _date(text: Column) -> Column:
    return F.when(text.rlike(_YEAR_FIRST + "$"), text.try_cast("date"))


def _reorder(text: Column, order: str) -> Column:
    return _date(F.regexp_replace(text, r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", order))


def parse_date(c: Column) -> Column:
    """The date a string spells, trying year-first, month-first and day-first forms; null if none fits.

    The forms are told apart by shape, so each value is cast once or twice and no parser error is raised.
    Slashes read month first, dashes with the year last read day first; the other order is the second try.
    """
    s = strip(c)
    month_first, day_first = "$3-$1-$2", "$3-$2-$1"
    return (
        F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _date(s))
        .when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), _date(F.translate(s, "/", "-")))
        .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.coalesce(_reorder(s, month_first), _reorder(s, day_first)))
        .when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.coalesce(_reorder(s, day_first), _reorder(s, month_first)))
        .when(s.rlike(_YEAR_FIRST + "T"), _date(F.split_part(s, F.lit("T"), F.lit(1))))
        .when(s.rlike(_YEAR_FIRST + _CLOCK + "$"), _date(F.regexp_extract(s, r"^\S+", 0)))
    )


def is_date_format(c: Column) -> Column:
    """Whether a string has one of the accepted date shapes, whatever date it spells."""
    return matches(strip(c), "|".join(f"(?:{pattern})" for pattern in DATE_FORMATS))


def date_of(df: DataFrame, name: str) -> Column:
    """A column as a date: by cast where it is a date or timestamp, else parsed."""
    if families(df)[name] == "datetime":
        return col(name).cast("date")
    return parse_date(col(name).cast("string"))
