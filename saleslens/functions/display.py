"""Report text: currency, percentages, counts and dates. A missing value shows as ``-``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "-"


def shown(text: Column) -> Column:
    return F.coalesce(text, F.lit(MISSING))


def whole(column: Column) -> Column:
    """``1,234``"""
    return shown(F.format_number(column, 0))


def currency(column: Column, symbol: str = "$") -> Column:
    """``$1,234``"""
    return shown(F.concat(F.lit(symbol), F.format_number(column.cast("double"), 0)))


def percent(column: Column) -> Column:
    """A share such as 0.123 as ``12.3%``; halves are judged on the stored double."""
    number = F.call_function("format_number", column.cast("double") * 100, F.lit("0.0"))
    return shown(F.concat(number, F.lit("%")))


def day(column: Column) -> Column:
    """``03 Feb 2016``"""
    return shown(F.date_format(column, "dd MMM yyyy"))
