"""Small text helpers shared by the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Cut all white space at both ends, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def non_blank(text: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def fold(text: Column) -> Column:
    """Case folding: lower case, and the sharp s as two letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def group_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """A regular-expression group, or null where the pattern is not found."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def number(text: Column) -> Column:
    """A number, or null when the text is none."""
    return text.try_cast("double")
