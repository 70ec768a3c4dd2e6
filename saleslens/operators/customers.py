"""Customer page: who buys again, and where they live.

Two definitions of a repeat customer are in use and kept apart: more than one fact row, or more
than one distinct order. Both start from one row per customer, so that neither a customer with a
huge share of the sales nor the customer join ever meets single fact rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.functions.numeric import ratio, six_places, with_known

TOP_STATES = 15
MIN_CUSTOMERS = 2
DRAFT_MIN_CUSTOMERS = 10


def rows_per_customer(sales: DataFrame, *places: str) -> DataFrame:
    """``lines``: fact rows of the customer; ``order_rows``: those of them that name an order.

    ``places`` are columns of the sales that say where the customer lives, kept beside the key.
    """
    named = F.when(F.col("order_id").isNotNull(), F.col("line_count"))
    return (
        with_known(sales, "customer_id")
        .groupBy("customer_id", *places)
        .agg(
            F.sum("line_count").alias("lines"),
            F.coalesce(F.sum(named), F.lit(0)).alias("order_rows"),
        )
    )


def orders_per_customer(sales: DataFrame) -> DataFrame:
    return (
        with_known(sales, "customer_id")
        .groupBy("customer_id")
        .agg(F.count_distinct("order_id").alias("order_count"))
    )


def repeat_kpi(per_customer: DataFrame) -> DataFrame:
    """Customers, those with more than one fact row, and their share."""
    return per_customer.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("lines") > 1).alias("repeat_customers"),
    ).withColumn(
        "repeat_rate", six_places(ratio(F.col("repeat_customers"), F.col("total_customers")))
    )


def repeat_by_rows(per_customer: DataFrame, place: str) -> DataFrame:
    """Per place: customers, fact rows with an order, and how many customers have several.

    ``per_customer`` is ``rows_per_customer`` with the customer's place joined on: one row per
    customer, or per customer and place.
    """
    repeats = F.count_if(F.col("order_rows") > 1)
    return with_known(per_customer, place).groupBy(place).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("order_rows").alias("orders"),
        six_places(ratio(repeats, F.count(F.lit(1)))).alias("repeat_rate"),
        repeats.alias("repeat_customers"),
        (F.count(F.lit(1)) - repeats).alias("non_repeat_customers"),
    )


def repeat_by_orders(per_customer: DataFrame, place: str) -> DataFrame:
    """Per place: share of customers with more than one distinct order, and customers.

    ``per_customer`` is ``orders_per_customer`` with the customer's place joined on.
    """
    return (
        with_known(per_customer, place)
        .groupBy(place)
        .agg(
            six_places(
                ratio(F.count_if(F.col("order_count") > 1), F.count(F.lit(1)))
            ).alias("repeat_rate"),
            F.count(F.lit(1)).alias("customers"),
        )
    )


def by_repeat_rate(by_place: DataFrame, place: str) -> DataFrame:
    """Highest repeat rate first, equal ones by place."""
    return by_place.orderBy(F.desc("repeat_rate"), place)


def count_by(per_customer: DataFrame, place: str) -> DataFrame:
    """Customers per place, of a frame with one row per customer."""
    return with_known(per_customer, place).groupBy(place).agg(F.count(F.lit(1)).alias("customers"))


def customers_by(customers: DataFrame, place: str) -> DataFrame:
    """Distinct customers per place, of a customer dimension or of customers with sales."""
    return (
        with_known(customers, place)
        .groupBy(place)
        .agg(F.count_distinct("customer_id").alias("customers"))
    )


def top_by_customers(by_place: DataFrame, place: str, n: int = TOP_STATES) -> DataFrame:
    return by_place.orderBy(F.desc("customers"), place).limit(n)


def top_by_repeat_rate(
    by_place: DataFrame, place: str, min_customers=MIN_CUSTOMERS, n: int = TOP_STATES
) -> DataFrame:
    """The highest repeat rates among places with at least ``min_customers`` customers.

    ``min_customers`` is a number or a one-row frame holding it.
    """
    if isinstance(min_customers, DataFrame):
        min_customers = min_customers.scalar()
    enough = by_place.filter(F.col("customers") >= min_customers)
    return enough.orderBy(F.desc("repeat_rate"), place).limit(n)


def largest_place(per_customer: DataFrame, *places: str) -> DataFrame:
    """Customers of the largest place of any kind (city, state), at least 1.

    Each customer counts once for every kind of place it has, so the frame, one row per customer,
    is read once.
    """
    kinds = F.array(*[F.struct(F.lit(p).alias("kind"), F.col(p).alias("place")) for p in places])
    sizes = (
        with_known(per_customer.select(F.inline(kinds)), "place")
        .groupBy("kind", "place")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    largest = F.coalesce(F.max("customers"), F.lit(1).cast("bigint"))
    return sizes.agg(F.greatest(F.lit(1).cast("bigint"), largest).alias("max_cust"))


def with_default_threshold(largest: DataFrame) -> DataFrame:
    """Adds ``min_c``, the preset customer threshold: 10, or less when no place has that many."""
    preset = F.least(F.lit(DRAFT_MIN_CUSTOMERS).cast("bigint"), F.col("max_cust"))
    return largest.withColumn("min_c", preset)
