"""Time from order to shipping, per store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.functions.numeric import quotient, six_places, with_known


def shipping_totals(lags: DataFrame, key: str) -> DataFrame:
    """Sums that means can be taken of later, one row per ``key``.

    ``lags`` carries ``order_to_ship_days`` and ``on_time`` of each sale, shipped or not.
    """
    return lags.groupBy(key).agg(
        F.sum("order_to_ship_days").alias("days"),
        F.count("order_to_ship_days").alias("shipped"),
        F.count_if("on_time").alias("on_time"),
        F.count(F.lit(1)).alias("sales"),
    )


def ship_performance(totals: DataFrame, name: str = "store_name") -> DataFrame:
    """Mean days over the shipped sales; share on time over all sales, unshipped included."""
    return (
        with_known(totals, name)
        .groupBy(name)
        .agg(
            six_places(quotient(F.sum("days"), F.sum("shipped"))).alias("avg_days"),
            six_places(quotient(F.sum("on_time"), F.sum("sales"))).alias("on_time_rate"),
        )
    )


def ship_trend(by_store: DataFrame) -> DataFrame:
    """Least-squares line of the on-time rate over the mean days, across stores."""
    rate, days = F.col("on_time_rate"), F.col("avg_days")
    return by_store.agg(
        six_places(F.regr_slope(rate, days)).alias("slope"),
        six_places(F.regr_intercept(rate, days)).alias("intercept"),
        six_places(F.regr_r2(rate, days)).alias("r2"),
    )
