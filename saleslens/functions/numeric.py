"""Arithmetic with the null, zero and rounding rules every report shares.

Amounts of single sales are multiplied as doubles and then snapped to whole millionths, which
recovers the exact product of a price in cents and rates in percent for sales of up to 9e9; of
larger ones a double keeps its 15 digits, and one of 9.2e12 or more is an error. From there they are integers
in a decimal type: sums cannot depend on the order in which a cluster adds its rows, and a total
is turned back into a double once, when it is published.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000


def number(name: str) -> Column:
    """A stored number as a double; an undefined one counts as missing."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def whole_micros(amount: Column) -> Column:
    """An amount of one sale as a whole number of millionths."""
    return F.rint(amount * MICROS).cast("bigint")


def exact(micros: Column) -> Column:
    """Millionths in the type they are summed in, which holds any of them; sums get ten digits more."""
    return micros.cast("decimal(19,0)")


def published(total_micros: Column) -> Column:
    """A total of millionths as the amount a report shows."""
    return (total_micros * F.lit(Decimal("0.000001"))).cast("double")


def row_amount(micros: Column) -> Column:
    """Millionths of one sale as an amount."""
    return micros.cast("double") / MICROS


def total(name: str) -> Column:
    """Sum that is 0, not null, when there is nothing to add."""
    return F.coalesce(F.sum(name), F.lit(0))


def published_total(name: str) -> Column:
    return published(total(name)).alias(name)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 when the denominator is 0 or missing."""
    return F.coalesce(quotient(numerator, denominator), F.lit(0.0))


def quotient(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def six_places(column: Column) -> Column:
    """Ratios and means are published to six places; beyond that engines differ in the last bits."""
    return F.round(column, 6)


def half_even_cents(column: Column) -> Column:
    """Two decimals, halves to the even neighbour: 0.125 gives 0.12."""
    return F.rint(column * 100) / 100


def margin_percent(profit: Column, net: Column) -> Column:
    """Profit as a percentage of net, row by row.

    A zero net amount keeps its infinity with the sign of the profit; only the undefined cases
    (0/0, or a missing side) become 0.
    """
    at_zero = (
        F.when(profit > 0, F.lit(float("inf")))
        .when(profit < 0, F.lit(float("-inf")))
        .otherwise(F.lit(0.0))
    )
    return (
        F.when(profit.isNull() | net.isNull(), F.lit(0.0))
        .when(net == 0, at_zero)
        .otherwise(quotient(profit, net) * 100)
    )


def with_known(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose group keys are all present; a missing key never forms a group."""
    return df.filter(reduce(Column.__and__, [F.col(key).isNotNull() for key in keys]))
