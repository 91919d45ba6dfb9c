"""Text expressions with the semantics that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` strips spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    """UTF-8 bytes div 4."""
    return F.floor(F.octet_length(text) / 4).cast("bigint")


def one_decimal(size: Column) -> Column:
    """A size as text with one decimal, halves to even."""
    return F.format_string("%.1f", F.bround(size.cast("double"), 1))


def is_bold(weight: Column) -> Column:
    return F.coalesce(F.lower(weight).contains("bold"), F.lit(False))


def is_italic(style: Column) -> Column:
    return F.coalesce(F.lower(style).contains("italic"), F.lit(False))
