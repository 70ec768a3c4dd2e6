"""Report filters: a date range, optional lists of names, and optional cube slicers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SalesFilter:
    """Choices of a report page. An empty choice does not filter."""

    date_from: date | None = None
    date_to: date | None = None
    stores: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()

    def dims(self) -> tuple[str, ...]:
        """The dimensions that hold the chosen names."""
        product = ("product",) if self.brands or self.categories else ()
        return product + (("store",) if self.stores else ())

    def apply(self, sales: DataFrame) -> DataFrame:
        sales = in_date_range(sales, self.date_from, self.date_to)
        sales = in_list(sales, "store_name", self.stores)
        sales = in_list(sales, "brand_name", self.brands)
        return in_list(sales, "category_name", self.categories)


def in_date_range(
    sales: DataFrame, date_from: date | None = None, date_to: date | None = None
) -> DataFrame:
    """Both ends included. Compares the stored timestamp, so that the range reaches the scan."""
    ordered = F.col("order_date")
    if date_from is not None:
        sales = sales.filter(ordered >= _midnight(date_from))
    if date_to is not None:
        sales = sales.filter(ordered < _midnight(date_to + timedelta(days=1)))
    return sales


def calendar_range(
    year: int | None, quarter: int | None = None, month: int | None = None
) -> tuple[date | None, date | None]:
    """First and last day that the calendar slicers leave; without a year they leave no one range."""
    if year is None:
        return None, None
    first, last = 1, 12
    if quarter is not None:
        first, last = 3 * quarter - 2, 3 * quarter
    if month is not None:
        first, last = max(first, month), min(last, month)
    if first > last or not 1 <= first <= 12:
        return date(year, 1, 1), date(year, 1, 1) - timedelta(days=1)
    after = date(year + last // 12, last % 12 + 1, 1)
    return date(year, first, 1), after - timedelta(days=1)


def _midnight(day: date):
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def in_list(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return df.filter(F.col(column).isin(list(values))) if values else df


def slice_cube(
    cube: DataFrame,
    year: int | None = None,
    quarter: int | None = None,
    month: int | None = None,
    city: str | None = None,
    category: str | None = None,
    *,
    city_column: str = "city_customer",
    category_column: str = "category_product",
) -> DataFrame:
    """Rows of the cube that match every slicer that is set."""
    wanted = {
        "year_date": year,
        "quarter_date": quarter,
        "month_date": month,
        city_column: city,
        category_column: category,
    }
    for column, value in wanted.items():
        if value is not None:
            cube = cube.filter(F.col(column) == value)
    return cube
