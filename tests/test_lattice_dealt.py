"""The warehouse lattice over lines that lie with their order, and over those that may not."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from saleslens.operators import cube
from saleslens.plans import frames, lattice
from saleslens.sources.retail import Retail
from shop import values

ROWS = {
    "region": ("r_regionkey bigint, r_name string", [(0, "R")]),
    "nation": ("n_nationkey bigint, n_name string, n_regionkey bigint", [(0, "A", 0), (1, "B", 0)]),
    "customer": (
        "c_custkey bigint, c_name string, c_mktsegment string, c_nationkey bigint",
        [(1, "x", "S", 0), (2, "y", "T", 1), (3, "z", None, None)],
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double",
        [(1, "bolt", "Brand#1", "LARGE", 3.1), (2, "ring", "Brand#2", "SMALL", 7.7), (2, "ring", "Brand#2", "LARGE", 7.9),
         (3, None, "Brand#3", "SMALL", None)],
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
        [(n, n % 4, datetime(2000 + n % 2, 1 + n % 12, 3)) for n in range(40)] + [(41, 1, None), (None, 2, datetime(2000, 1, 3))],
    ),
}
LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
)
DEALT = ("order_id", lattice.STREWN)


def line(order, part, number):
    return (order, part, 1, number, 2.0, 10.01 * (part or 5) + (number or 0), 0.05, 0.02, datetime(2000, 5, 1))


#: Sales in one cell and in several, repeated, without an order, a line number or a part.
USUAL = (
    [line(n % 43, n % 5, n % 8) for n in range(400)]
    + [line(7, 1, 3), line(7, 1, 3), line(7, 3, 3)]
    + [line(None, n % 3, n % 4) for n in range(20)]
    + [line(4, 1, None), line(4, 2, None), line(None, None, None)]
)
#: Numbers of two digits and below 0 give sales the number of another order's sale.
BEYOND = USUAL + [line(5, 1, 13), line(6, 2, 3), line(9, 1, -7), line(8, 2, 3)]


def tables(spark, folder, lines):
    for name, (schema, rows) in (ROWS | {"lineitem": (LINES, lines)}).items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return Retail(spark, str(folder))


def same(mine, theirs):
    def shown(df):
        return sorted(str(tuple(round(v, 4) if isinstance(v, float) else v for v in row)) for row in values(df))

    assert shown(mine) == shown(theirs)


@pytest.mark.parametrize("lines", [USUAL, BEYOND], ids=["usual", "beyond"])
def test_reports_equal_the_row_level_cube(spark, tmp_path, lines):
    data = tables(spark, tmp_path, lines)
    rows, built = frames.warehouse_slice(data), frames.warehouse_lattice(data)
    assert built.sizes[()] > 0
    same(built.slice().kpi(), cube.cube_kpi(rows))
    same(built.slice(year=2001).kpi(), cube.cube_kpi(rows.filter("year_date = 2001")))
    same(built.slice().top_products(), cube.top_revenue(rows, "product_name_product"))
    same(built.slice().months(), cube.month_financial(rows))
    same(built.slice().summary(), cube.cube_summary(rows, "category_product", "city_customer"))


def test_lines_are_moved_once_to_their_order(spark, tmp_path):
    data = tables(spark, tmp_path, USUAL)
    finest = lattice.WAREHOUSE.columns(lattice.KEPT[0])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = lattice._with_shared(lattice._words(frames.warehouse_sales(data), finest, DEALT), DEALT)
        text = words._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    exchanges = [found for found in text.splitlines() if "Exchange hashpartitioning" in found]
    assert not any("key_word" in found for found in exchanges)
    assert sum("order_id" in found for found in exchanges) == 2


def test_lines_without_an_order_are_strewn(spark, tmp_path):
    data = tables(spark, tmp_path, [line(None, 1, n) for n in range(50)] + USUAL)
    strewn = frames.warehouse_sales(data).filter("order_id IS NULL")
    assert strewn.select(lattice.STREWN).distinct().count() > 50
    assert frames.warehouse_sales(data).filter("order_id IS NOT NULL AND strewn <> 0").isEmpty()


def test_margins_of_single_rows_are_not_stored(spark, tmp_path):
    rows = frames.warehouse_sales(tables(spark, tmp_path, USUAL))
    finest = lattice.WAREHOUSE.columns(lattice.KEPT[0])
    words = lattice._with_shared(lattice._words(rows, finest, DEALT), DEALT).cache()
    narrow = lattice._narrow(words, finest)
    assert narrow.filter("margins = 1 AND margin IS NOT NULL").isEmpty()
    assert not narrow.filter("margins > 1").isEmpty()
    added = [F.sum("margin"), F.sum("margins")]
    same(lattice._with_margins(narrow).agg(*added), words.agg(*added))
