"""Growth reads and prices the last two periods with sales only, whatever the orders' dates promise."""

from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import differences
from saleslens.plans import frames
from saleslens.plans.catalog import CATALOG
from saleslens.plans.oracle import ORACLE
from saleslens.sources.retail import retail

SOURCE = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
GROWTH = {"period_growth": "month", "period_growth_quarter": "quarter", "period_growth_year": "year"}


def copied(spark, folder, **changed):
    for name in TABLES:
        rows = spark.read.parquet(f"{SOURCE}/{name}.parquet")
        changed.get(name, lambda rows: rows)(rows).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def ordered(*days):
    """The orders and, on these days, some without lines."""

    def more(orders):
        kind = orders.schema["o_orderdate"].dataType
        extra = orders.limit(1).withColumn("day", F.explode(F.array(*map(F.lit, days))))
        extra = extra.withColumn("o_orderdate", F.col("day").cast(kind))
        return orders.unionByName(extra.withColumn("o_orderkey", -F.unix_date(F.col("day").cast("date")).cast("bigint")).drop("day"))

    return more


def check(spark, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    for name in GROWTH:
        mine, theirs = CATALOG[name](spark, folder).toArrow(), con.sql(ORACLE[name]).to_arrow_table()
        assert differences(mine, theirs) == [], name


def test_later_orders_without_lines_widen_the_range(spark, tmp_path):
    later = [datetime(2001 + k, 1 + k, 5) for k in range(5)]
    check(spark, copied(spark, tmp_path, orders=ordered(*later)))


def test_one_period_and_no_dates_have_no_growth(spark, tmp_path):
    same = lambda rows: rows.withColumn("o_orderdate", F.lit(datetime(1999, 5, 5)).cast(rows.schema["o_orderdate"].dataType))
    check(spark, copied(spark, tmp_path / "one", orders=same))
    none = lambda rows: rows.withColumn("o_orderdate", F.lit(None).cast(rows.schema["o_orderdate"].dataType))
    check(spark, copied(spark, tmp_path / "none", orders=none))


def test_an_empty_fact_has_no_growth(spark, tmp_path):
    check(spark, copied(spark, tmp_path, lineitem=lambda rows: rows.limit(0)))


def test_the_range_reaches_the_scan_of_the_orders(spark):
    plan = frames.sales_since(retail(spark, SOURCE), date(1998, 6, 1))._jdf.queryExecution().executedPlan().toString()
    orders = next(line for line in plan.splitlines() if "orders.parquet" in line)
    assert "GreaterThanOrEqual(o_orderdate,1998-06-01" in orders
    assert plan.count("lineitem.parquet") == 1
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("period", GROWTH.values())
def test_two_periods_are_summed(spark, period):
    assert frames.latest_trend(retail(spark, SOURCE), period).count() == 2
