"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(col: Column | str) -> Column:
    """Remove all white space at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def money(col: Column | str) -> Column:
    """``1,234.50``, halves rounded to even."""
    return F.format_number(F.bround(col, 2), 2)


def fixed(col: Column | str, digits: int) -> Column:
    """Fixed number of digits without separators, halves rounded to even."""
    value = F.col(col) if isinstance(col, str) else col
    return F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits))


def present(col: Column | str) -> Column:
    """True where a text is neither null nor empty."""
    return F.coalesce(F.length(col) > 0, F.lit(False))
