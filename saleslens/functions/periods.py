"""Calendar keys and day differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = ("month", "quarter", "year")


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def month_key(day: Column) -> Column:
    """``2016-02``; null for a missing date."""
    return F.concat(F.year(day).cast("string"), F.lit("-"), two_digits(F.month(day)))


def quarter_key(day: Column) -> Column:
    """``2016Q1``; null for a missing date."""
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def with_period_columns(sales: DataFrame) -> DataFrame:
    """``year``, ``quarter``, ``month`` and ``date`` of ``order_date``."""
    day = F.col("order_date").cast("date")
    return sales.withColumns(
        {
            "year": F.year(day),
            "quarter": quarter_key(day),
            "month": month_key(day),
            "date": day,
        }
    )


def with_time_hierarchy(cube: DataFrame) -> DataFrame:
    """``year_month`` (``2016-02``) and ``year_quarter`` (``2016-Q1``) from the joined calendar."""
    year, quarter, month = (
        F.col(name).cast("int") for name in ("year_date", "quarter_date", "month_date")
    )
    return cube.withColumns(
        {
            "year_date": year,
            "quarter_date": quarter,
            "month_date": month,
            "year_month": F.concat(year.cast("string"), F.lit("-"), two_digits(month)),
            "year_quarter": F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string")),
        }
    )


def whole_days(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, rounded down: a lag of -36 hours is -2 days."""
    start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    nights = F.datediff(end, start)
    overshoots = start + F.make_dt_interval(nights) > end
    return nights - F.when(overshoots, 1).otherwise(0)


def with_ship_lag(sales: DataFrame) -> DataFrame:
    """Days from order to shipping, and whether that met the order date.

    An order that never shipped has no lag and is not on time.
    """
    lag = whole_days(F.col("order_date"), F.col("shipped_date"))
    return sales.withColumns(
        {"order_to_ship_days": lag, "on_time": F.coalesce(lag <= 0, F.lit(False))}
    )
