"""Whole pages over random shops, against DuckDB on the same rows, plus laws the tables obey."""

import math

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from saleslens.functions.measures import to_grain
from saleslens.operators import cube, customers, sales
from saleslens.operators.filters import SalesFilter
from saleslens.plans import pages
from saleslens.sources.sinks import shared
from shop import random_shop_rows, shop, values

SEEDS = (1, 2)

# One row per sale with every name joined on; each check below is plain SQL over it.
WIDE = """
CREATE TABLE f AS
SELECT f.*, quantity * f.list_price * (1 - discount) AS net_sales,
       strftime(order_date, '%Y-%m') AS month,
       product_name, brand_name, category_name, store_name, customer_city, customer_state,
       staff_fullname, p.list_price AS unit_cost, d.month_name, d.year
FROM fact_sales f
LEFT JOIN dim_products p USING (product_id)
LEFT JOIN dim_brands USING (brand_id)
LEFT JOIN dim_categories USING (category_id)
LEFT JOIN dim_stores s ON f.store_id = s.store_id
LEFT JOIN dim_customers USING (customer_id)
LEFT JOIN dim_staffs st ON f.staff_id = st.staff_id
LEFT JOIN dim_date d ON CAST(order_date AS DATE) = date_key
"""


class Shop:
    def __init__(self, spark, seed):
        rows = random_shop_rows(seed)
        self.tables = shop(spark, rows)
        self.frame = pages.sales_frame(self.tables)
        self.con = duckdb.connect()
        for name, df in self.tables.items():
            table: pa.Table = df.toArrow()
            self.con.register("loaded", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM loaded")
            self.con.unregister("loaded")
        self.con.execute(WIDE)
        self.con.execute("CREATE TABLE all_sales AS SELECT * FROM f")
        self.con.execute("DELETE FROM f WHERE order_date IS NULL")

    def sql(self, text):
        return self.con.execute(text).fetchall()


@pytest.fixture(scope="module", params=SEEDS)
def random_shop(request, spark):
    return Shop(spark, request.param)


def same(df, expected, ordered=False):
    got, want = values(df), list(expected)
    if not ordered:
        key = lambda row: tuple((v is None, str(v)) for v in row)
        got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want), (got, want)
    for mine, theirs in zip(got, want):
        assert len(mine) == len(theirs)
        for a, b in zip(mine, theirs):
            if isinstance(a, float) and b is not None:
                assert math.isclose(a, float(b), rel_tol=1e-9, abs_tol=2e-6), (mine, theirs)
            else:
                assert a == b, (mine, theirs)


def test_sales_page(random_shop):
    with shared(random_shop.frame) as frame:
        page = pages.sales_page(frame, "month")
        sql = random_shop.sql
        same(
            page["kpi"],
            sql(
                "SELECT sum(net_sales), count(DISTINCT order_id), count(DISTINCT customer_id), "
                "sum(net_sales) / count(DISTINCT order_id) FROM f"
            ),
        )
        trend = sql(
            "SELECT month, coalesce(sum(net_sales), 0), count(DISTINCT order_id) FROM f "
            "WHERE month IS NOT NULL GROUP BY 1 ORDER BY 1"
        )
        same(page["trend"], trend, ordered=True)
        (_, before, orders_before), (_, now, orders_now) = trend[-2:]
        growth = ((now - before) / before, (orders_now - orders_before) / orders_before)
        same(page["growth"], [growth])
        for kind, measure in (("revenue", "net_sales"), ("quantity", "quantity")):
            for suffix, keys in (("", "product_name"), ("_by_id", "product_id, product_name")):
                same(
                    page[f"top_{kind}{suffix}"],
                    sql(
                        f"SELECT {keys}, coalesce(sum({measure}), 0) AS m FROM f "
                        f"WHERE product_name IS NOT NULL GROUP BY {keys} ORDER BY m DESC, {keys} "
                        "LIMIT 10"
                    ),
                    ordered=True,
                )
        grouped = "FROM f WHERE brand_name IS NOT NULL AND category_name IS NOT NULL GROUP BY"
        summed = "coalesce(sum(net_sales), 0)"
        same(
            page["brand_category"],
            sql(f"SELECT brand_name, category_name, {summed} {grouped} 1, 2"),
        )
        same(
            page["brand_category_rollup"],
            sql(
                "SELECT brand_name, category_name, grouping(brand_name, category_name), "
                f"{summed} {grouped} ROLLUP (brand_name, category_name)"
            ),
        )
        same(page["dates"], sql("SELECT min(order_date)::DATE, max(order_date)::DATE FROM f"))
        for closed, low, high in (("left", ">=", "<"), ("right", ">", "<=")):
            shown = values(page[f"discount_{closed}"])
            total = sum(row[2] for row in shown)
            top = "1.0" if closed == "left" else "0.20"
            start = "0" if closed == "left" else "-0.01"
            expected = sql(
                "SELECT sum(quantity) FROM f "
                f"WHERE discount {low} {start} AND discount {high} {top}"
            )
            assert [(total,)] == expected


def by_rows(place):
    return (
        f"SELECT {place}, count(*), sum(n)::BIGINT, avg((n > 1)::INT), "
        "count(*) FILTER (WHERE n > 1), count(*) FILTER (WHERE n <= 1) FROM "
        f"(SELECT {place}, customer_id, count(order_id) n FROM f WHERE {place} IS NOT NULL "
        "GROUP BY 1, 2) GROUP BY 1"
    )


def by_orders(place):
    return (
        f"SELECT {place}, avg((n > 1)::INT) AS r, count(*) AS c FROM "
        f"(SELECT {place}, customer_id, count(DISTINCT order_id) n FROM f "
        f"WHERE {place} IS NOT NULL GROUP BY 1, 2) GROUP BY 1"
    )


def test_customer_page(random_shop):
    sql = random_shop.sql
    with shared(random_shop.frame) as frame:
        page = pages.customer_page(frame, random_shop.tables["dim_customers"])
        same(
            page["kpi"],
            sql(
                "SELECT count(*), count(*) FILTER (WHERE n > 1), avg((n > 1)::INT) FROM "
                "(SELECT customer_id, count(*) n FROM f WHERE customer_id IS NOT NULL GROUP BY 1)"
            ),
        )
        for name, place in (("state", "customer_state"), ("city", "customer_city")):
            same(page[f"repeat_by_{name}"], sql(by_rows(place)))
            same(page[f"repeat_by_{name}_orders"], sql(by_orders(place)))
        same(
            page["customers_by_state"],
            sql(
                "SELECT customer_state, count(DISTINCT customer_id) FROM f "
                "WHERE customer_state IS NOT NULL GROUP BY 1"
            ),
        )
        same(
            page["customers_by_state_dim"],
            sql(
                "SELECT customer_state, count(DISTINCT customer_id) FROM dim_customers "
                "WHERE customer_state IS NOT NULL GROUP BY 1"
            ),
        )
        largest = max(
            row[2] for place in ("customer_state", "customer_city") for row in sql(by_orders(place))
        )
        assert values(page["threshold"]) == [(largest, min(10, largest))]
        same(
            page["top_repeat_cities_orders"],
            sql(
                f"SELECT * FROM ({by_orders('customer_city')}) WHERE c >= {min(10, largest)} "
                "ORDER BY round(r, 6) DESC, 1 LIMIT 15"
            ),
            ordered=True,
        )
        # The two definitions differ, and orders never exceed rows.
        rows = {row[0]: row[3] for row in values(page["repeat_by_state"])}
        orders = {row[0]: row[1] for row in values(page["repeat_by_state_orders"])}
        assert all(orders[state] <= rows[state] for state in rows)
        for row in values(page["repeat_by_state"]):
            assert row[4] + row[5] == row[1]


def performance(name):
    return (
        f"SELECT {name}, coalesce(sum(net_sales), 0) AS s, count(DISTINCT order_id) AS o FROM f "
        f"WHERE {name} IS NOT NULL GROUP BY 1"
    )


def test_employee_page(random_shop):
    sql = random_shop.sql
    with shared(random_shop.frame) as frame:
        page = pages.employee_page(frame, random_shop.tables["dim_staffs"])
        stores, staffs = performance("store_name"), performance("staff_fullname")
        same(page["stores_by_sales"], sql(f"{stores} ORDER BY s DESC, 1"), ordered=True)
        same(page["stores_by_orders"], sql(f"{stores} ORDER BY o DESC, 1"), ordered=True)
        same(page["top_staff_sales"], sql(f"{staffs} ORDER BY s DESC, 1 LIMIT 10"), ordered=True)
        same(page["top_staff_orders"], sql(f"{staffs} ORDER BY o DESC, 1 LIMIT 10"), ordered=True)
        same(
            page["best_staff"],
            sql(f"SELECT staff_fullname, s FROM ({staffs}) ORDER BY s DESC, 1 LIMIT 1"),
        )
        same(
            page["kpi"],
            sql(
                "SELECT (SELECT count(DISTINCT staff_id) FROM dim_staffs), avg(s) FROM "
                "(SELECT staff_id, coalesce(sum(net_sales), 0) s FROM f "
                "WHERE staff_id IS NOT NULL GROUP BY 1)"
            ),
        )
        for name, column in (("sales", "s"), ("orders", "o")):
            shares = page[f"store_{name}_share"]
            same(
                shares,
                sql(
                    f"SELECT store_name, {column}, {column} / sum({column}) OVER () "
                    f"FROM ({stores})"
                ),
            )
            assert math.isclose(sum(row[2] for row in values(shares)), 1, abs_tol=1e-5)
        assert math.isclose(sum(r[2] for r in values(page["staff_sales_share"])), 1, abs_tol=1e-5)
        lag = "floor((epoch(shipped_date) - epoch(order_date)) / 86400)"
        shipping = (
            f"SELECT store_name, avg({lag}) AS x, avg(coalesce({lag} <= 0, false)::INT) AS y "
            "FROM f WHERE store_name IS NOT NULL GROUP BY 1"
        )
        same(page["shipping"], sql(shipping))
        line = sql(
            "SELECT regr_slope(y, x), regr_intercept(y, x), regr_r2(y, x) "
            f"FROM (SELECT round(x, 6) x, round(y, 6) y FROM ({shipping}))"
        )
        same(page["shipping_trend"], line)


def test_shop_cube_page(random_shop):
    whole = cube.shop_cube(random_shop.tables["fact_sales"], random_shop.tables)
    assert whole.count() == 400
    random_shop.con.execute(
        "CREATE OR REPLACE VIEW c AS SELECT *, net_amount AS revenue, "
        "net_amount - quantity * coalesce(unit_cost, 0) AS profit, "
        "CASE WHEN net_amount = 0 THEN CASE WHEN quantity * coalesce(unit_cost, 0) > 0 "
        "THEN '-inf'::DOUBLE ELSE 0 END "
        "ELSE (net_amount - quantity * coalesce(unit_cost, 0))::DOUBLE / net_amount * 100 END "
        "AS margin FROM all_sales"
    )
    sql = random_shop.sql
    with shared(whole) as kept:
        page = pages.shop_page(kept)
        same(
            page["kpi"],
            sql(
                "SELECT sum(revenue), sum(profit), count(DISTINCT sale_id), avg(revenue), "
                "avg(margin), sum(quantity) FROM c"
            ),
        )
        for name, key in (("top_products", "product_name"), ("top_cities", "customer_city")):
            same(
                page[name],
                sql(
                    f"SELECT {key}, sum(revenue) r FROM c WHERE {key} IS NOT NULL GROUP BY 1 "
                    "ORDER BY r DESC, 1 LIMIT 10"
                ),
                ordered=True,
            )
        same(
            page["categories"],
            sql(
                "SELECT category_name, sum(revenue) FROM c WHERE category_name IS NOT NULL "
                "GROUP BY 1"
            ),
        )
        # The calendar matches days, so a time of day must not keep a sale from its month.
        same(
            page["months"],
            sql(
                "SELECT month_name, sum(revenue), sum(profit) FROM c "
                "WHERE month_name IS NOT NULL GROUP BY 1"
            ),
        )
        same(
            page["summary"],
            sql(
                "SELECT category_name, customer_city, "
                "round_even(sum(revenue)::DOUBLE * 100, 0) / 100, "
                "round_even(sum(profit)::DOUBLE * 100, 0) / 100, sum(quantity)::BIGINT, "
                "count(DISTINCT sale_id) FROM c WHERE category_name IS NOT NULL "
                "AND customer_city IS NOT NULL GROUP BY 1, 2"
            ),
        )


def test_filters_narrow_a_page(random_shop):
    choice = SalesFilter(stores=("Store 1", "Store 2"), brands=("Brand 0",))
    frame = pages.sales_frame(random_shop.tables, choice)
    same(
        sales.sales_kpi(frame).select("orders", "customers"),
        random_shop.sql(
            "SELECT count(DISTINCT order_id), count(DISTINCT customer_id) FROM f "
            "WHERE store_name IN ('Store 1', 'Store 2') AND brand_name = 'Brand 0'"
        ),
    )


def test_reports_do_not_depend_on_the_grain(random_shop):
    frame = random_shop.frame.unionByName(random_shop.frame)
    keys = ("order_id", "customer_id", "month", "store_name", "product_name")
    coarse = to_grain(frame, *keys)
    assert coarse.count() <= frame.count() / 2
    for report in (
        sales.sales_kpi,
        lambda df: sales.sales_trend(df, "month"),
        lambda df: sales.top_products(df, "net_sales"),
        lambda df: customers.repeat_kpi(customers.rows_per_customer(df)),
    ):
        same(report(coarse), values(report(frame)))


def test_rollup_parents_are_the_sums_of_their_leaves(random_shop):
    rows = values(sales.brand_category_rollup(random_shop.frame))
    leaves = [row for row in rows if row[2] == 0]
    for brand, _, level, net in rows:
        if level == 1:
            assert math.isclose(net, sum(row[3] for row in leaves if row[0] == brand))
        if level == 3:
            assert math.isclose(net, sum(row[3] for row in leaves))


def test_bins_and_the_unbinned_add_up(random_shop):
    from saleslens.functions.bins import RIGHT_CLOSED

    frame = random_shop.frame
    binned = sum(row[2] for row in values(sales.discount_effect(frame, RIGHT_CLOSED)))
    outside = frame.filter(RIGHT_CLOSED.ordinal(F.col("discount")).isNull())
    rest = outside.agg(F.sum("quantity")).collect()[0][0]
    assert binned + rest == frame.agg(F.sum("quantity")).collect()[0][0]


def test_reports_straight_from_the_star_equal_the_pages(random_shop):
    tables = random_shop.tables
    choice = SalesFilter(
        stores=tuple(x for (x,) in random_shop.sql("SELECT store_name FROM dim_stores LIMIT 2")),
        brands=tuple(x for (x,) in random_shop.sql("SELECT brand_name FROM dim_brands LIMIT 3")),
    )
    for chosen in (SalesFilter(), choice):
        frame = pages.sales_frame(tables, chosen)
        whole = pages.sales_page(frame, "month", tables["fact_sales"])
        lean = pages.sales_report(tables, chosen)
        for name in ("kpi", "top_revenue", "top_quantity_by_id", "brand_category_rollup"):
            same(lean[name], values(whole[name]))
    people = pages.customer_report(tables, choice)
    state = "customer_state"
    by_state = customers.repeat_by_rows(
        customers.rows_per_customer(pages.sales_frame(tables, choice), state), state
    )
    same(people["repeat_by_state"], values(by_state))
    staff = pages.employee_page(pages.sales_frame(tables, choice), tables["dim_staffs"])
    same(pages.employee_report(tables, choice)["kpi"], values(staff["kpi"]))
