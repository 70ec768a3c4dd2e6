"""Row measures of the sales fact, and the additive grain they can be summed to.

Every sales measure here is linear in the rows it covers: quantities, amounts and row counts of
two groups simply add. A *sales frame* may therefore hold fact rows or any pre-aggregation of
them; the reports only add measures and count distinct keys, so they give the same answer on
both. ``to_grain`` is how a plan shrinks the fact (map-side first) before it meets a join, which
also keeps a hot key from reaching the join as more than one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.functions.numeric import (
    exact,
    margin_percent,
    number,
    row_amount,
    whole_micros,
)

ADDITIVE = (
    "quantity",
    "discounted_units",
    "net_sales",
    "line_count",
    "revenue",
    "gross_revenue",
    "discount_amount",
    "total_cost",
    "profit",
    "order_value",
)


def _undiscounted() -> Column:
    return number("quantity") * (1 - number("discount"))


def with_net_sales(sales: DataFrame) -> DataFrame:
    """``quantity * list_price * (1 - discount)``, in millionths"""
    amount = number("quantity") * number("list_price") * (1 - number("discount"))
    return sales.withColumn("net_sales", exact(whole_micros(amount)))


def with_discounted_units(sales: DataFrame) -> DataFrame:
    """``quantity * (1 - discount)``, in millionths: the part of net sales that does not need the
    price, and so can be summed before it is known."""
    return sales.withColumn("discounted_units", exact(whole_micros(_undiscounted())))


def with_priced_units(by_product: DataFrame) -> DataFrame:
    """Net sales of summed ``discounted_units`` that share one list price; exact in decimals for
    prices of up to six places."""
    unit_price = number("list_price").cast("decimal(20,6)")
    return by_product.withColumn(
        "net_sales", (F.col("discounted_units") * unit_price).cast("decimal(38,0)")
    )


def with_line_count(fact: DataFrame) -> DataFrame:
    return fact.withColumn("line_count", F.lit(1).cast("bigint"))


def to_grain(sales: DataFrame, *keys: str) -> DataFrame:
    """Sum the additive measures the frame has, one row per distinct ``keys``.

    Missing keys stay as their own row: the totals over the frame do not change.
    """
    measures = [F.sum(name).alias(name) for name in ADDITIVE if name in sales.columns]
    return sales.groupBy(*keys).agg(*measures)


def with_revenue(fact: DataFrame) -> DataFrame:
    """Net amount in millionths, for reports that need no other cube amount."""
    return fact.withColumn("revenue", exact(whole_micros(number("net_amount"))))


def with_cube_amounts(cube: DataFrame, unit_cost: str, *extras: str) -> DataFrame:
    """Amounts of the sales cube, in millionths.

    ``unit_cost`` is the product column a unit costs; ``extras`` are the charges that join the
    net amount in ``order_value``. Missing costs and charges count as 0.
    """
    zero = F.lit(0.0)
    net, gross = whole_micros(number("net_amount")), whole_micros(number("gross_amount"))
    cost = whole_micros(number("quantity") * F.coalesce(number(unit_cost), zero))
    order_value = net
    for extra in extras:
        order_value = order_value + whole_micros(F.coalesce(number(extra), zero))
    amounts = {
        "revenue": net,
        "gross_revenue": gross,
        "discount_amount": gross - net,
        "total_cost": cost,
        "profit": net - cost,
        "order_value": order_value,
    }
    return cube.withColumns({name: exact(micros) for name, micros in amounts.items()})


def with_margin(cube: DataFrame) -> DataFrame:
    """Margin of each row; not additive, so it is only defined on fact rows."""
    profit, net = row_amount(F.col("profit")), row_amount(F.col("revenue"))
    return cube.withColumn("profit_margin", margin_percent(profit, net))
