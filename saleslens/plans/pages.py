"""The report pages over a loaded star: one filtered frame, and every table a page shows.

The frame behind a page is read by all of its tables, so a caller who wants several of them
should hold it with ``sources.sinks.shared`` while collecting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.functions.bins import LEFT_CLOSED, RIGHT_CLOSED
from saleslens.functions.measures import to_grain, with_line_count, with_net_sales
from saleslens.functions.periods import PERIODS, with_period_columns, with_ship_lag
from saleslens.operators import cube, customers, options, sales, shipping, staff
from saleslens.operators.enrich import (
    DIMENSIONS,
    enrich,
    product_dimension,
    with_customer_geo,
    with_products,
    with_staff_names,
)
from saleslens.operators.filters import SalesFilter
from saleslens.sources.store import bucketed

Tables = dict[str, DataFrame]
Page = dict[str, DataFrame]


def sales_frame(
    tables: Tables, choice: SalesFilter = SalesFilter(), dims: tuple[str, ...] = DIMENSIONS
) -> DataFrame:
    """Sales with net sales, period columns and dimension names, narrowed to ``choice``.

    Joined are ``dims`` and the dimensions that ``choice`` filters by. A sale without an order date lies in no range, not even the default one of all days.
    """
    fact = with_period_columns(with_net_sales(with_line_count(tables["fact_sales"])))
    wide = enrich(fact, tables, (*dims, *choice.dims()))
    return choice.apply(wide).filter(F.col("order_date").isNotNull())


def kept_orders(frame: DataFrame, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """A stored copy of ``frame`` at order grain, in sorted buckets of the order, with periods.

    Trend, repeat customers and whatever else counts orders read it without a shuffle by order, in
    this and in later jobs. An order with several customers or dates has a row for each.
    """
    summed = to_grain(frame, "order_id", "customer_id", "order_date")
    return with_period_columns(bucketed(summed, "order_id", buckets, path))


def product_sales(frame: DataFrame, tables: Tables) -> DataFrame:
    """``frame`` with product names: summed by product before they are joined, unless it has them."""
    if "product_name" in frame.columns:
        return frame
    summed = to_grain(frame.select("product_id", "quantity", "net_sales"), "product_id")
    names = product_dimension(tables["dim_products"], tables["dim_categories"], tables["dim_brands"])
    return with_products(summed, names)


def sales_report(
    tables: Tables, choice: SalesFilter = SalesFilter(), period: str = "month"
) -> Page:
    """The sales page straight from the star: figures without names join no dimension but those
    that ``choice`` filters by, and the others join it to sales summed by product."""
    frame = sales_frame(tables, choice, ())
    return sales_page(frame, period, tables["fact_sales"], product_sales(frame, tables))


def customer_report(tables: Tables, choice: SalesFilter = SalesFilter()) -> Page:
    """The customer page straight from the star."""
    return customer_page(sales_frame(tables, choice, ()), tables["dim_customers"])


def employee_report(tables: Tables, choice: SalesFilter = SalesFilter()) -> Page:
    """The employee page straight from the star."""
    return employee_page(sales_frame(tables, choice, ("store",)), tables["dim_staffs"])


def choices(tables: Tables) -> DataFrame:
    """What the page filters can be set to."""
    return options.filter_options(
        (tables["dim_stores"], {"store": "store_name"}),
        (tables["dim_brands"], {"brand": "brand_name"}),
        (tables["dim_categories"], {"category": "category_name"}),
    )


def sales_page(
    frame: DataFrame,
    period: str = "month",
    fact: DataFrame | None = None,
    products: DataFrame | None = None,
) -> Page:
    """The tables of the page. ``fact`` is the unfiltered fact, whose first and last day limit the
    choice of dates whatever is chosen; ``products`` is the frame with product names, at any grain.
    Without them the frame stands in for both."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}")
    trend = sales.sales_trend(frame, period)
    by_id = ("product_id", "product_name")
    named = frame if products is None else products
    return {
        "kpi": sales.sales_kpi(frame),
        "dates": sales.date_bounds(frame if fact is None else fact),
        "trend": trend.orderBy(period),
        "growth": sales.period_growth(trend, period),
        "top_revenue": sales.top_products(named, "net_sales"),
        "top_quantity": sales.top_products(named, "quantity"),
        "top_revenue_by_id": sales.top_products(named, "net_sales", by_id),
        "top_quantity_by_id": sales.top_products(named, "quantity", by_id),
        "brand_category": sales.brand_category_sales(named),
        "brand_category_rollup": sales.brand_category_rollup(named),
        "discount_left": sales.discount_effect(frame, LEFT_CLOSED),
        "discount_right": sales.discount_effect(frame, RIGHT_CLOSED),
    }


def customer_page(frame: DataFrame, dim_customers: DataFrame) -> Page:
    """The tables of the page. Where customers live is joined to one row per customer, so the frame
    needs no dimension."""
    state, city = "customer_state", "customer_city"
    counted = customers.rows_per_customer(frame)
    located = with_customer_geo(counted, dim_customers)
    by_state = customers.repeat_by_rows(located, state)
    by_city = customers.repeat_by_rows(located, city)
    ordered = with_customer_geo(customers.orders_per_customer(frame), dim_customers)
    state_orders = customers.repeat_by_orders(ordered, state)
    city_orders = customers.repeat_by_orders(ordered, city)
    threshold = customers.with_default_threshold(customers.largest_place(ordered, city, state))
    enough = threshold.select("min_c")
    return {
        "kpi": customers.repeat_kpi(counted),
        "customers_by_state": customers.count_by(located, state),
        "customers_by_state_dim": customers.customers_by(dim_customers, state),
        "repeat_by_state": by_state,
        "repeat_by_city": by_city,
        "top_states": customers.top_by_customers(by_state, state),
        "top_repeat_states": customers.top_by_repeat_rate(by_state, state),
        "repeat_by_state_orders": customers.by_repeat_rate(state_orders, state),
        "repeat_by_city_orders": customers.by_repeat_rate(city_orders, city),
        "threshold": threshold,
        "top_repeat_states_orders": customers.top_by_repeat_rate(state_orders, state, enough),
        "top_repeat_cities_orders": customers.top_by_repeat_rate(city_orders, city, enough),
    }


def employee_page(frame: DataFrame, dim_staffs: DataFrame) -> Page:
    store, name = "store_name", "staff_fullname"
    stores = staff.performance(frame, store)
    staffs = staff.performance(with_staff_names(frame, dim_staffs), name)
    top = staff.ranked(staffs, name, "net_sales", staff.TOP_STAFF)
    shipped = shipping.ship_performance(shipping.shipping_totals(with_ship_lag(frame), store))
    return {
        "kpi": staff.staff_kpi(frame, dim_staffs),
        "best_staff": staff.best_staff(staffs),
        "stores_by_sales": staff.ranked(stores, store, "net_sales"),
        "stores_by_orders": staff.ranked(stores, store, "orders"),
        "store_sales_share": staff.share_of_total(stores, store, "net_sales"),
        "store_orders_share": staff.share_of_total(stores, store, "orders"),
        "top_staff_sales": top,
        "top_staff_orders": staff.ranked(staffs, name, "orders", staff.TOP_STAFF),
        "staff_sales_share": staff.share_within_top(top, name, "net_sales"),
        "shipping": shipped,
        "shipping_trend": shipping.ship_trend(shipped),
    }


def cube_page(slice_of_cube: DataFrame, category: str, city: str) -> Page:
    return {
        "kpi": cube.cube_kpi(slice_of_cube),
        "top_products": cube.top_revenue(slice_of_cube, "product_name_product"),
        "top_cities": cube.top_revenue(slice_of_cube, city),
        "categories": cube.revenue_by(slice_of_cube, category),
        "months": cube.month_financial(slice_of_cube),
        "summary": cube.cube_summary(slice_of_cube, category, city),
    }


def warehouse_page(slice_of_cube: DataFrame) -> Page:
    return cube_page(slice_of_cube, "category_product", "city_customer")


def shop_page(slice_of_cube: DataFrame) -> Page:
    return cube_page(slice_of_cube, "category_name_category", "customer_city_customer")
