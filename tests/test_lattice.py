"""Stored cuboids against the row-level cube, and the order copy against the page's frame."""

import pytest
from pyspark.sql import functions as F

from saleslens.operators import cube, customers, filters, sales
from saleslens.plans import frames, lattice, pages
from saleslens.plans.catalog import CATALOG
from saleslens.sources.retail import Retail
from shop import random_shop_rows, shop, values

SF_DIR = "/root/testdata/sf0.001"
SLICES = [
    {},
    {"year": 2016},
    {"year": 2016, "quarter": 2, "category": "Category 1"},
    {"month": 3, "city": "City 2"},
    {"city": "City 5", "category": "Category 0"},
    {"category": "none"},
]


@pytest.fixture(scope="module")
def rows(spark):
    tables = shop(spark, random_shop_rows(5))
    return cube.shop_cube(tables["fact_sales"], tables).cache()


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('lattice')}"
    lattice.build(rows, lattice.SHOP, path)
    return lattice.opened(spark, lattice.SHOP, path)


def same(mine, theirs):
    def shown(df):
        return sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in row) for row in values(df))

    assert shown(mine) == shown(theirs)


@pytest.mark.parametrize("chosen", SLICES, ids=str)
def test_reports_equal_the_row_level_cube(rows, stored, chosen):
    names = {"city_column": lattice.SHOP.city, "category_column": lattice.SHOP.category}
    page = pages.shop_page(filters.slice_cube(rows, **chosen, **names))
    sliced = stored.slice(**chosen)
    same(sliced.kpi(), page["kpi"])
    same(sliced.top_products(), page["top_products"])
    same(sliced.top_cities(), page["top_cities"])
    same(sliced.categories(), page["categories"])
    same(sliced.months(), page["months"])
    same(sliced.summary(), page["summary"])


def test_a_slice_is_read_from_the_smallest_cuboid(stored):
    assert stored.slice().axes() in (("calendar",), ("city", "category"))
    assert stored.slice(year=2016).axes() == ("calendar",)
    assert stored.slice(year=2016, city="City 1").axes() == ("calendar", "city")
    assert stored.slice(city="City 1").axes("category") == ("city", "category")
    assert "product" in stored.slice(category="Category 1").axes("product")
    for needed in lattice.KEPT:
        found = stored.smallest(*needed)
        assert set(needed) <= set(found)
        assert all(stored.sizes[found] <= n for axes, n in stored.sizes.items() if set(needed) <= set(axes))


@pytest.mark.parametrize("chosen", [{}, {"month": 13}, {"city": "City 2"}], ids=str)
def test_a_sale_in_several_cells_counts_once(rows, tmp_path, chosen):
    """Copies of a sale in its own cell, and of every third in another one, and sales without a number."""
    moved = rows.filter("sale_id % 3 = 0").withColumns({"month_date": F.lit(13), lattice.SHOP.city: F.lit("City 2")})
    unknown = rows.limit(9).withColumn("sale_id", F.lit(None).cast("bigint"))
    mixed = rows.union(rows).union(moved).union(unknown)
    built = lattice.build(mixed, lattice.SHOP, f"file://{tmp_path}")
    assert built.sizes[()] > 0
    names = {"city_column": lattice.SHOP.city, "category_column": lattice.SHOP.category}
    page = pages.shop_page(filters.slice_cube(mixed, **chosen, **names))
    same(built.slice(**chosen).kpi(), page["kpi"])
    same(built.slice(**chosen).summary(), page["summary"])


def test_bitmaps_are_of_the_sales_in_several_cells(rows, tmp_path):
    moved = rows.filter("sale_id % 3 = 0").withColumn(lattice.SHOP.city, F.lit("City 2"))
    unknown = rows.limit(9).withColumn("sale_id", F.lit(None).cast("bigint"))
    mixed = rows.union(rows).union(moved).union(unknown)
    cells = lattice.SHOP.columns(lattice.KEPT[0])
    held = mixed.filter("sale_id IS NOT NULL").select("sale_id", *cells).distinct()
    several = {row.sale_id for row in held.groupBy("sale_id").count().filter("count > 1").collect()}
    built = lattice.build(mixed, lattice.SHOP, f"file://{tmp_path}")
    found = [(row.key_word * 64 + bit) for row in built.cuboid(()).collect() for bit in range(64) if row.key_bits >> bit & 1]
    assert several and set(found) == several
    assert len(found) == held.filter(F.col("sale_id").isin(several)).count()


def test_rows_are_dealt_by_word_once(rows):
    """Cells by word and the bits they share take one shuffle, of narrow rows."""
    finest = lattice.SHOP.columns(lattice.KEPT[0])
    text = plan(lattice._with_shared(lattice._words(rows, finest)))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "key_word" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_COL" in exchanges[0]


def test_no_bitmaps_are_kept_for_sales_in_one_cell(stored):
    assert stored.sizes[()] == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["lattice_slice_kpi", "lattice_summary"])
def test_lattice_queries_scan_no_fact(spark, name):
    text = plan(CATALOG[name](spark, SF_DIR))
    assert "cuboid=" in text and "lineitem" not in text and "orders.parquet" not in text


@pytest.fixture(scope="module")
def kept(spark):
    tables = shop(spark, random_shop_rows(6))
    frame = pages.sales_frame(tables)
    return frame, pages.kept_orders(frame, buckets=3)


def test_the_order_copy_gives_the_same_reports(kept):
    frame, copy = kept
    for period in ("month", "quarter", "year"):
        same(sales.sales_trend(copy, period), sales.sales_trend(frame, period))
    same(sales.sales_kpi(copy), sales.sales_kpi(frame))
    same(customers.rows_per_customer(copy), customers.rows_per_customer(frame))
    same(customers.orders_per_customer(copy), customers.orders_per_customer(frame))


def test_the_order_copy_is_read_without_a_shuffle_by_order(spark, kept):
    _, copy = kept
    for report in (sales.sales_trend(copy, "month"), customers.orders_per_customer(copy)):
        text = plan(report)
        assert "Bucketed: true" in text
        exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
        assert exchanges and not any("order_id" in line for line in exchanges)
    for name in ("kept_trend_month", "kept_repeat_by_city_orders"):
        text = plan(CATALOG[name](spark, SF_DIR))
        assert "lineitem" not in text and "hashpartitioning(order_id" not in text


def test_the_lattice_of_the_warehouse_counts_every_sale(spark):
    built = frames.warehouse_lattice(Retail(spark, SF_DIR))
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber")
    assert built.slice().kpi().first().total_orders == lines.distinct().count()
    assert built.sizes[("calendar",)] < built.sizes[lattice.KEPT[0]]
