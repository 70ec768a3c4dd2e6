"""Employee page: stores, staff and their shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saleslens.functions.bitmaps import by_word, keys_in
from saleslens.functions.numeric import (
    published,
    published_total,
    quotient,
    ratio,
    six_places,
    total,
    with_known,
)

TOP_STAFF = 10


def performance(sales: DataFrame, name: str) -> DataFrame:
    """Net sales and distinct orders per store or staff name, in one pass: orders are bits of
    words, and the sales of a word's orders are summed beside them."""
    words = by_word(with_known(sales, name), "order_id", name, net_sales=F.sum("net_sales"))
    return words.groupBy(name).agg(published_total("net_sales"), keys_in().alias("orders"))


def net_sales_by(sales: DataFrame, name: str) -> DataFrame:
    return with_known(sales, name).groupBy(name).agg(published_total("net_sales"))


def orders_by(sales: DataFrame, name: str) -> DataFrame:
    return by_word(with_known(sales, name), "order_id", name).groupBy(name).agg(keys_in().alias("orders"))


def ranked(by_name: DataFrame, name: str, measure: str, n: int | None = None) -> DataFrame:
    """Largest ``measure`` first, equal ones by name; all of them, or the first ``n``."""
    ordered = by_name.orderBy(F.desc(measure), name)
    return ordered if n is None else ordered.limit(n)


def staff_kpi(sales: DataFrame, staffs: DataFrame) -> DataFrame:
    """Staff in the dimension, and mean net sales of the staff who sold.

    The two counts come from different tables; both are reduced to one row per staff member and
    read together, which needs no join.
    """
    sold = (
        with_known(sales, "staff_id")
        .groupBy("staff_id")
        .agg(total("net_sales").alias("net_sales"))
        .select(F.lit(None).cast("bigint").alias("member"), "net_sales")
    )
    listed = (
        with_known(staffs, "staff_id")
        .select(F.col("staff_id").alias("member"))
        .distinct()
        .withColumn("net_sales", F.lit(None).cast(sold.schema["net_sales"].dataType))
    )
    mean = six_places(ratio(published(F.sum("net_sales")), F.count("net_sales")))
    return (
        sold.unionByName(listed)
        .agg(F.count("member").alias("total_staffs"), mean.alias("avg_sales_per_staff"))
        .withColumn(
            "avg_sales_per_staff",
            F.when(F.col("total_staffs") > 0, F.col("avg_sales_per_staff")).otherwise(0.0),
        )
    )


def best_staff(by_name: DataFrame) -> DataFrame:
    """The staff name with the largest net sales; of equal ones the first name."""
    return ranked(by_name, "staff_fullname", "net_sales", 1).select(
        F.col("staff_fullname").alias("best_staff"), F.col("net_sales").alias("best_staff_sales")
    )


def share_of_total(by_name: DataFrame, name: str, measure: str) -> DataFrame:
    """Each row's part of the sum over all rows.

    The sum is a scalar subquery over the same aggregate, so the rows stay distributed.
    """
    slim = by_name.select(name, measure)
    whole = slim.agg(F.sum(measure)).scalar()
    return slim.withColumn("share", six_places(quotient(F.col(measure), whole)))


def share_within_top(top: DataFrame, name: str, measure: str) -> DataFrame:
    """Each row's part of the sum over a short ranked list (one window over its few rows)."""
    whole = F.sum(measure).over(Window.partitionBy())
    return top.select(
        name, measure, six_places(quotient(F.col(measure), whole)).alias("share")
    )
