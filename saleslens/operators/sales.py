"""Sales page: KPIs, trend, growth, products, brands and discounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.functions import bitmaps
from saleslens.functions.bins import Bins
from saleslens.functions.numeric import (
    published,
    published_total,
    quotient,
    ratio,
    six_places,
    total,
    with_known,
)

TOP_PRODUCTS = 10


def sales_kpi(sales: DataFrame) -> DataFrame:
    """Total sales, distinct orders and customers, and sales per order, at any grain, in one pass
    that shuffles bitmaps of the keys instead of the rows."""
    found = bitmaps.counts(sales, "net_sales", "order_id", "customer_id")
    counted = found.select(
        published(F.coalesce("net_sales", F.lit(0))).alias("total_sales"),
        F.col("order_id").alias("orders"),
        F.col("customer_id").alias("customers"),
    )
    return counted.withColumn("aov", six_places(ratio(F.col("total_sales"), F.col("orders"))))


def sales_kpi_of_orders(orders: DataFrame, days: bool = False) -> DataFrame:
    """The same for a frame with one row per order, where orders need not be told apart: summed per
    customer, then over all, without a copy of the rows for each distinct count. ``days`` adds the
    first and last order date."""
    dates = {"first_day": F.min, "last_day": F.max} if days else {}
    by_customer = orders.groupBy("customer_id").agg(
        F.sum("net_sales").alias("net_sales"),
        F.count("order_id").alias("orders"),
        *(of("order_date").alias(name) for name, of in dates.items()),
    )
    counted = by_customer.agg(
        published(total("net_sales")).alias("total_sales"),
        total("orders").alias("orders"),
        F.count("customer_id").alias("customers"),
        *(of(name).alias(name) for name, of in dates.items()),
    )
    return counted.withColumn("aov", six_places(ratio(F.col("total_sales"), F.col("orders"))))


def sales_trend(sales: DataFrame, period: str) -> DataFrame:
    """Net sales and distinct orders per ``period`` column."""
    return (
        with_known(sales, period)
        .groupBy(period)
        .agg(published_total("net_sales"), F.count_distinct("order_id").alias("orders"))
    )


def period_growth(trend: DataFrame, period: str) -> DataFrame:
    """Relative change of the last period over the one before.

    Null when there are fewer than two periods, or when the earlier one was 0. Only the two
    latest rows of the trend are compared.
    """
    last_two = trend.orderBy(F.desc(period)).limit(2)
    both = last_two.agg(
        F.count(F.lit(1)).alias("periods"),
        F.max_by("net_sales", period).alias("sales"),
        F.min_by("net_sales", period).alias("sales_before"),
        F.max_by("orders", period).alias("orders"),
        F.min_by("orders", period).alias("orders_before"),
    )

    def change(now: str, before: str):
        grown = quotient(F.col(now) - F.col(before), F.col(before))
        return F.when(F.col("periods") == 2, six_places(grown))

    return both.select(
        change("sales", "sales_before").alias("sales_growth"),
        change("orders", "orders_before").alias("orders_growth"),
    )


def top_products(
    sales: DataFrame, measure: str, keys: tuple[str, ...] = ("product_name",), n: int = TOP_PRODUCTS
) -> DataFrame:
    """The ``n`` products with the largest ``measure``; equal ones in key order.

    Keyed by name alone, products that share a name count as one.
    """
    shown = F.col(measure).cast("bigint") if measure == "quantity" else published(F.col(measure))
    return (
        with_known(sales, *keys)
        .groupBy(*keys)
        .agg(total(measure).alias(measure))
        .orderBy(F.desc(measure), *keys)
        .limit(n)
        .withColumn(measure, shown)
    )


def brand_category_sales(sales: DataFrame) -> DataFrame:
    return (
        with_known(sales, "brand_name", "category_name")
        .groupBy("brand_name", "category_name")
        .agg(published_total("net_sales"))
    )


def brand_category_rollup(sales: DataFrame) -> DataFrame:
    """Brand to category hierarchy: leaves (level 0), brands (1) and the grand total (3).

    The subtotals are added up from the leaves, not from the sales again.
    """
    leaves = (
        with_known(sales, "brand_name", "category_name")
        .groupBy("brand_name", "category_name")
        .agg(total("net_sales").alias("net_sales"))
    )
    return leaves.rollup("brand_name", "category_name").agg(
        F.grouping_id().cast("int").alias("level"), published_total("net_sales")
    )


def discount_effect(sales: DataFrame, bins: Bins) -> DataFrame:
    """Quantity and net sales per discount range, empty ranges included.

    ``sales`` holds the discounts, or is summed by their ``bin`` already. Every bin contributes one row of zeros, so an empty bin needs no join to appear. Sales
    outside the ranges belong to no bin.
    """
    place = F.col("bin") if "bin" in sales.columns else bins.ordinal(F.col("discount"))
    binned = with_known(sales.select(place.alias("bin"), "quantity", "net_sales"), "bin")
    summed = binned.groupBy("bin").agg(
        total("quantity").alias("quantity"), total("net_sales").alias("net_sales")
    )
    zeros = bins.all(sales.sparkSession).select(
        "bin", F.lit(0).alias("quantity"), F.lit(0).alias("net_sales")
    )
    return (
        summed.unionByName(zeros)
        .groupBy("bin")
        .agg(F.sum("quantity").alias("quantity"), F.sum("net_sales").alias("net_sales"))
        .select(
            "bin",
            bins.label(F.col("bin")).alias("discount_range"),
            F.col("quantity").cast("bigint").alias("total_qty"),
            published(F.col("net_sales")).alias("total_sales"),
        )
    )


def date_bounds(sales: DataFrame) -> DataFrame:
    return sales.agg(
        F.min("order_date").cast("date").alias("min_date"),
        F.max("order_date").cast("date").alias("max_date"),
    )
