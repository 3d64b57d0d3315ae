"""Character classes and pattern matching on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import sql_string

# Digit characters outside the decimal digits: superscripts, subscripts, circled and dingbat digits.
_OTHER_DIGITS = (
    r"\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}"
    r"\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
)

# A character belongs to the first class it matches; what is left after these is split by code point.
CLASS_STEPS: tuple[tuple[str, str], ...] = (
    ("alphabetic", r"\p{L}+"),
    ("numeric", rf"[\p{{Nd}}{_OTHER_DIGITS}]+"),
    ("alphanumeric", r"\p{N}+"),
    ("whitespace", r"(?U)[\s\x1c-\x1f]+"),
    ("unicode", r"[^\x00-\x7F]+"),
)
CHAR_CLASSES = tuple(name for name, _ in CLASS_STEPS) + ("special_chars",)


def strip_sql(text: str, regex: str) -> str:
    """SQL of a string without the characters a pattern matches; an empty string is left alone."""
    return f"IF({text} = '', '', regexp_replace({text}, {sql_string(regex)}, ''))"


def _anchored(pattern: str) -> str:
    return f"(?dU)^(?:{pattern})"


def matches(c: Column, pattern: str) -> Column:
    r"""Pattern test at the start of the string, with Unicode ``\d`` and ``\s``, and ``\n`` as the only line end ``$``
    may precede."""
    return c.rlike(_anchored(pattern))


def matches_sql(text: str, pattern: str) -> str:
    """The same test as SQL text."""
    return f"rlike({text}, {sql_string(_anchored(pattern))})"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))
