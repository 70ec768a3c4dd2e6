"""The registered queries: name -> function of a session and a table directory."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.functions import display
from saleslens.functions.bins import LEFT_CLOSED, RIGHT_CLOSED
from saleslens.functions.measures import with_net_sales
from saleslens.functions.numeric import ratio, row_amount
from saleslens.functions.periods import with_period_columns
from saleslens.operators import cube, customers, enrich, filters, options, quality, sales, shipping, staff
from saleslens.plans import frames, pages
from saleslens.sources import store
from saleslens.sources.parquet import load_shop
from saleslens.sources.retail import Retail, retail, with_charges
from saleslens.sources.schemas import SUMMARY
from saleslens.sources.sinks import read_csv, write_csv

Query = Callable[[SparkSession, str], DataFrame]

CATALOG: dict[str, Query] = {}

# Choices the filter queries are registered with.
RANGE = filters.SalesFilter(date_from=date(1998, 1, 1), date_to=date(1998, 3, 31))
LISTS = filters.SalesFilter(
    stores=("NATION_1", "NATION_7", "NATION_12"),
    brands=("Brand#2", "Brand#17", "Brand#4"),
    categories=("ECONOMY", "SMALL"),
)
SLICE = {"year": 1998, "quarter": 1, "category": "ECONOMY"}


def query(build: Callable[[Retail], DataFrame]) -> Callable[[Retail], DataFrame]:
    CATALOG[build.__name__] = lambda spark, path: build(retail(spark, path))
    return build


def _amounts(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: row_amount(F.col(name)) for name in names})


def _iso(name: str) -> Column:
    """A date as ISO text, which every client shows alike."""
    return F.col(name).cast("date").cast("string").alias(name)


# Row-level columns


@query
def net_sales_rows(data: Retail) -> DataFrame:
    rows = frames.priced_lines(data).select(
        "sale_id", "product_id", "quantity", "list_price", "discount", "net_sales"
    )
    return _amounts(rows, "net_sales")


@query
def period_columns(data: Retail) -> DataFrame:
    dated = with_period_columns(data.orders())
    rows = data.lines().join(dated, "order_id", "left")
    return rows.select("sale_id", "year", "quarter", "month", _iso("date"))


@query
def ship_lag_rows(data: Retail) -> DataFrame:
    return frames.ship_lags(data).select("sale_id", "order_to_ship_days", "on_time")


AMOUNTS = (
    "revenue",
    "gross_revenue",
    "discount_amount",
    "total_cost",
    "profit",
    "order_value",
)


def _measures(costed: DataFrame) -> DataFrame:
    rows = cube.with_margin(costed).select("sale_id", *AMOUNTS, "profit_margin")
    return _amounts(rows, *AMOUNTS).withColumn("profit_margin", F.round("profit_margin", 6))


@query
def cube_measures_b(data: Retail) -> DataFrame:
    return _measures(frames.warehouse_costed(data))


@query
def cube_measures_a(data: Retail) -> DataFrame:
    return _measures(frames.shop_costed(data))


TIME_KEYS = ("year_date", "quarter_date", "month_date", "year_month", "year_quarter")


@query
def time_hierarchy(data: Retail) -> DataFrame:
    headers = cube.with_calendar(data.warehouse_orders(), data.dates(), "order_date_key")
    headers = cube.with_time_hierarchy(headers).select("order_id", *TIME_KEYS)
    return data.lines().join(headers, "order_id", "left").select("sale_id", *TIME_KEYS)


# Joins


def _star(enriched: DataFrame) -> DataFrame:
    rows = enriched.select(
        "sale_id",
        "order_id",
        "customer_id",
        "product_id",
        _iso("order_date"),
        "quantity",
        "net_sales",
        "product_name",
        "category_name",
        "brand_name",
        "store_name",
        "customer_city",
        "customer_state",
    )
    return _amounts(rows, "net_sales")


@query
def star_enriched(data: Retail) -> DataFrame:
    return _star(frames.enriched_lines(data))


@query
def star_of_tables(data: Retail) -> DataFrame:
    """The same by the joins of a loaded star, brand and category from tables of their own."""
    tables = data.shop()
    return _star(enrich.enrich(with_net_sales(tables["fact_sales"]), tables))


@query
def snowflake_products(data: Retail) -> DataFrame:
    return enrich.product_dimension(data.snowflake_products(), data.categories(), data.brands())


def _warehouse_rows(cube_: DataFrame) -> DataFrame:
    rows = cube_.select(
        "sale_id",
        _iso("order_date_key"),
        "customer_key",
        "employee_key",
        "product_key",
        "quantity",
        "month_name_date",
        *TIME_KEYS,
        "company_name_customer",
        "city_customer",
        "country_region_customer",
        "full_name_employee",
        "city_employee",
        "product_name_product",
        "category_product",
        *AMOUNTS,
        F.round("profit_margin", 6).alias("profit_margin"),
    )
    return _amounts(rows, *AMOUNTS)


@query
def cube_b(data: Retail) -> DataFrame:
    return _warehouse_rows(frames.warehouse_rows(data))


@query
def cube_b_of_tables(data: Retail) -> DataFrame:
    """The same by the joins of a loaded star. Employees are stored like those of one: Spark can size
    a stored table, not the result of a join, and moves no sale for employees it can send around."""
    tables = data.warehouse()
    tables["dim_employees"] = store.stored(tables["dim_employees"])
    return _warehouse_rows(cube.warehouse_cube(tables["fact_sales"], tables, with_charges))


def _shop_rows(cube_: DataFrame) -> DataFrame:
    rows = cube_.select(
        "sale_id",
        "customer_id",
        "staff_id",
        "product_id",
        "quantity",
        "month_name_date",
        *TIME_KEYS,
        "customer_fullname_customer",
        "customer_city_customer",
        "staff_fullname_staff",
        "product_name_product",
        "brand_name_brand",
        "category_name_category",
        "store_name_store",
        *AMOUNTS,
        F.round("profit_margin", 6).alias("profit_margin"),
    )
    return _amounts(rows, *AMOUNTS)


@query
def cube_a(data: Retail) -> DataFrame:
    return _shop_rows(frames.shop_rows(data))


@query
def cube_a_of_tables(data: Retail) -> DataFrame:
    tables = data.shop()
    return _shop_rows(cube.shop_cube(tables["fact_sales"], tables))


# Filters


@query
def sales_in_range(data: Retail) -> DataFrame:
    rows = RANGE.apply(frames.dated_lines(data)).select(
        "sale_id",
        "order_id",
        "customer_id",
        _iso("order_date"),
        "net_sales",
    )
    return _amounts(rows, "net_sales")


@query
def sales_by_lists(data: Retail) -> DataFrame:
    rows = LISTS.apply(frames.named_lines(data)).select(
        "sale_id", "store_name", "brand_name", "category_name", "quantity", "net_sales"
    )
    return _amounts(rows, "net_sales")


@query
def cube_slice(data: Retail) -> DataFrame:
    rows = frames.warehouse_slice(data, **SLICE).select(
        "sale_id", *TIME_KEYS, "city_customer", "category_product", "revenue", "profit"
    )
    return _amounts(rows, "revenue", "profit")


@query
def cube_slice_kpi(data: Retail) -> DataFrame:
    return cube.cube_kpi(frames.warehouse_slice(data, **SLICE, home=False))


@query
def filter_options(data: Retail) -> DataFrame:
    return options.filter_options(
        (data.stores(), {"store": "store_name"}),
        (data.products(), {"brand": "brand_name", "category": "category_name"}),
    )


@query
def cube_filter_options(data: Retail) -> DataFrame:
    orders, products = frames.sold(data)
    days = orders.select(F.col("order_date").cast("date").alias("order_date_key")).distinct()
    calendar = cube.with_calendar(days, data.dates(), "order_date_key")
    buyers = orders.select(F.col("customer_id").alias("customer_key")).distinct()
    places = frames.with_warehouse_home(buyers, data)
    return options.filter_options(
        (calendar, {"year": "year_date", "quarter": "quarter_date", "month": "month_date"}),
        (places, {"city": "city_customer"}),
        (products, {"category": "category_name"}),
    )


@query
def table_preview(data: Retail) -> DataFrame:
    """Every column of every table of the star; those that grow are joined for their heads only."""
    buyers = data.with_home(options.heads(data.buyers(), "customer_id"))
    products = options.heads(data.snowflake_products(), "product_id")
    facts = frames.star_lines(data, options.heads(data.lines(), "sale_id")).select(
        "sale_id",
        "order_id",
        "customer_id",
        "product_id",
        "store_id",
        "staff_id",
        _iso("order_date"),
        _iso("shipped_date"),
        "quantity",
        "list_price",
        "discount",
        "gross_amount",
        "net_amount",
    )
    return options.table_preview(
        {
            "dim_customers": buyers.select(*data.customers().columns),
            "dim_date": data.dates(),
            "dim_staffs": options.heads(data.staffs(), "staff_id"),
            "dim_products": products.select("product_id", "product_name", "brand_id", "category_id", "list_price"),
            "dim_brands": data.brands(),
            "dim_categories": data.categories(),
            "dim_stores": data.stores(),
            "fact_sales": facts,
        }
    )


@query
def star_audit(data: Retail) -> DataFrame:
    """The star written, loaded by its declared schema and checked."""
    path = store.new_path(data.spark)
    data.write_shop(path)
    return quality.audit(load_shop(data.spark, path))


@query
def exported_summary(data: Retail) -> DataFrame:
    """The cube's summary as its export holds it."""
    path = write_csv(cube_summary(data), store.new_path(data.spark), "summary")
    return read_csv(data.spark, path, SUMMARY)


# Sales page


@query
def sales_kpi(data: Retail) -> DataFrame:
    return sales.sales_kpi_of_orders(frames.order_sales(data))


@query
def kpi_display(data: Retail) -> DataFrame:
    figures = sales.sales_kpi_of_orders(frames.order_sales(data), days=True)
    return figures.select(
        display.currency(F.col("total_sales")).alias("total_sales"),
        display.whole(F.col("orders")).alias("orders"),
        display.whole(F.col("customers")).alias("customers"),
        display.currency(ratio(F.col("total_sales"), F.col("orders"))).alias("aov"),
        F.concat(
            display.day(F.col("first_day")), F.lit(" – "), display.day(F.col("last_day"))
        ).alias("caption"),
    )


@query
def page_kpi(data: Retail) -> DataFrame:
    """By the frame of a page over a loaded star, as are the next two."""
    return sales.sales_kpi(pages.sales_frame(data.shop(), dims=()))


@query
def page_brand_category(data: Retail) -> DataFrame:
    tables = data.shop()
    named = pages.product_sales(pages.sales_frame(tables, dims=()), tables)
    return sales.brand_category_sales(named)


@query
def page_repeat_by_state(data: Retail) -> DataFrame:
    tables = data.shop()
    counted = customers.rows_per_customer(pages.sales_frame(tables, dims=()))
    located = enrich.with_customer_geo(counted, tables["dim_customers"])
    return customers.repeat_by_rows(located, "customer_state")


@query
def kept_trend_month(data: Retail) -> DataFrame:
    """From the order copy of a page, as are the next three."""
    return sales.sales_trend(frames.kept_orders(data), "month").orderBy("month")


@query
def kept_repeat_kpi(data: Retail) -> DataFrame:
    return customers.repeat_kpi(customers.rows_per_customer(frames.kept_orders(data)))


@query
def kept_repeat_by_state(data: Retail) -> DataFrame:
    counted = customers.rows_per_customer(frames.kept_orders(data))
    located = enrich.with_customer_geo(counted, data.shop()["dim_customers"])
    return customers.repeat_by_rows(located, "customer_state")


@query
def kept_repeat_by_city_orders(data: Retail) -> DataFrame:
    counted = customers.orders_per_customer(frames.kept_orders(data))
    located = enrich.with_customer_geo(counted, data.shop()["dim_customers"])
    by_city = customers.repeat_by_orders(located, "customer_city")
    return customers.by_repeat_rate(by_city, "customer_city")


@query
def trend_month(data: Retail) -> DataFrame:
    return sales.sales_trend(frames.period_sales(data), "month").orderBy("month")


@query
def trend_quarter(data: Retail) -> DataFrame:
    return sales.sales_trend(frames.period_sales(data), "quarter").orderBy("quarter")


@query
def trend_year(data: Retail) -> DataFrame:
    return sales.sales_trend(frames.period_sales(data), "year").orderBy("year")


@query
def period_growth(data: Retail) -> DataFrame:
    return sales.period_growth(frames.latest_trend(data, "month"), "month")


@query
def period_growth_quarter(data: Retail) -> DataFrame:
    return sales.period_growth(frames.latest_trend(data, "quarter"), "quarter")


@query
def period_growth_year(data: Retail) -> DataFrame:
    return sales.period_growth(frames.latest_trend(data, "year"), "year")


@query
def top_products_revenue(data: Retail) -> DataFrame:
    return sales.top_products(frames.product_sales(data), "net_sales")


@query
def top_products_qty(data: Retail) -> DataFrame:
    return sales.top_products(frames.product_sales(data), "quantity")


BY_ID = ("product_id", "product_name")


@query
def top_products_revenue_by_id(data: Retail) -> DataFrame:
    return sales.top_products(frames.product_sales(data), "net_sales", BY_ID)


@query
def top_products_qty_by_id(data: Retail) -> DataFrame:
    return sales.top_products(frames.product_sales(data), "quantity", BY_ID)


@query
def brand_category_sales(data: Retail) -> DataFrame:
    return sales.brand_category_sales(frames.product_sales(data))


@query
def brand_category_rollup(data: Retail) -> DataFrame:
    return sales.brand_category_rollup(frames.product_sales(data))


@query
def discount_effect_left(data: Retail) -> DataFrame:
    return sales.discount_effect(frames.discount_sales(data, LEFT_CLOSED), LEFT_CLOSED)


@query
def discount_effect_right(data: Retail) -> DataFrame:
    return sales.discount_effect(frames.discount_sales(data, RIGHT_CLOSED), RIGHT_CLOSED)


@query
def date_bounds(data: Retail) -> DataFrame:
    bounds = sales.date_bounds(frames.order_sales(data, priced=False))
    return bounds.select(_iso("min_date"), _iso("max_date"))


# Customer page


@query
def repeat_kpi_rows(data: Retail) -> DataFrame:
    sold = frames.order_sales(data, priced=False)
    return customers.repeat_kpi(customers.rows_per_customer(sold))


@query
def repeat_by_state_rows(data: Retail) -> DataFrame:
    return customers.repeat_by_rows(frames.customer_rows(data), "customer_state")


@query
def repeat_by_city_rows(data: Retail) -> DataFrame:
    by_city = customers.repeat_by_rows(frames.customer_rows(data), "customer_city")
    return by_city.select("customer_city", "customers", "orders", "repeat_rate")


@query
def repeat_by_state_orders(data: Retail) -> DataFrame:
    by_state = customers.repeat_by_orders(frames.customer_orders(data), "customer_state")
    return customers.by_repeat_rate(by_state, "customer_state")


@query
def repeat_by_city_orders(data: Retail) -> DataFrame:
    by_city = customers.repeat_by_orders(frames.customer_orders(data), "customer_city")
    return customers.by_repeat_rate(by_city, "customer_city")


@query
def customers_by_state(data: Retail) -> DataFrame:
    return customers.count_by(frames.customer_rows(data), "customer_state")


@query
def customers_by_state_dim(data: Retail) -> DataFrame:
    return customers.customers_by(data.customers(), "customer_state")


@query
def top_states_customers(data: Retail) -> DataFrame:
    return customers.top_by_customers(repeat_by_state_rows(data), "customer_state")


@query
def top_states_repeat(data: Retail) -> DataFrame:
    return customers.top_by_repeat_rate(repeat_by_state_rows(data), "customer_state")


def _largest_place(data: Retail) -> DataFrame:
    return customers.largest_place(
        frames.customer_orders(data), "customer_city", "customer_state"
    )


@query
def customer_threshold(data: Retail) -> DataFrame:
    return customers.with_default_threshold(_largest_place(data))


@query
def top_cities_repeat(data: Retail) -> DataFrame:
    threshold = customers.with_default_threshold(_largest_place(data)).select("min_c")
    return customers.top_by_repeat_rate(repeat_by_city_orders(data), "customer_city", threshold)


@query
def top_states_repeat_orders(data: Retail) -> DataFrame:
    threshold = customers.with_default_threshold(_largest_place(data)).select("min_c")
    return customers.top_by_repeat_rate(repeat_by_state_orders(data), "customer_state", threshold)


@query
def repeat_display(data: Retail) -> DataFrame:
    by_state = customers.repeat_by_rows(frames.customer_rows(data), "customer_state")
    share = ratio(F.col("repeat_customers"), F.col("customers"))
    return by_state.select(
        "customer_state",
        display.whole(F.col("repeat_customers")).alias("repeat_customers"),
        display.whole(F.col("non_repeat_customers")).alias("non_repeat_customers"),
        display.percent(share).alias("repeat_rate"),
    )


# Employee page


def _stores(data: Retail) -> DataFrame:
    return staff.performance(frames.store_lines(data), "store_name")


@query
def store_performance(data: Retail) -> DataFrame:
    return staff.ranked(_stores(data), "store_name", "net_sales")


@query
def store_performance_orders(data: Retail) -> DataFrame:
    return staff.ranked(_stores(data), "store_name", "orders")


@query
def store_sales_share(data: Retail) -> DataFrame:
    stores = staff.net_sales_by(frames.store_sales(data), "store_name")
    return staff.share_of_total(stores, "store_name", "net_sales")


@query
def store_orders_share(data: Retail) -> DataFrame:
    stores = staff.orders_by(frames.store_order_lines(data), "store_name")
    return staff.share_of_total(stores, "store_name", "orders")


@query
def staff_kpi(data: Retail) -> DataFrame:
    return staff.staff_kpi(frames.staff_sales(data), data.staffs())


@query
def best_staff(data: Retail) -> DataFrame:
    return staff.best_staff(staff.net_sales_by(frames.named_staff_sales(data), "staff_fullname"))


def _staff_performance(data: Retail) -> DataFrame:
    return staff.performance(frames.named_staff_lines(data), "staff_fullname")


@query
def top_staff_sales(data: Retail) -> DataFrame:
    return staff.ranked(_staff_performance(data), "staff_fullname", "net_sales", staff.TOP_STAFF)


@query
def top_staff_orders(data: Retail) -> DataFrame:
    return staff.ranked(_staff_performance(data), "staff_fullname", "orders", staff.TOP_STAFF)


@query
def staff_sales_share(data: Retail) -> DataFrame:
    by_name = staff.net_sales_by(frames.named_staff_sales(data), "staff_fullname")
    top = staff.ranked(by_name, "staff_fullname", "net_sales", staff.TOP_STAFF)
    return staff.share_within_top(top, "staff_fullname", "net_sales")


@query
def ship_performance(data: Retail) -> DataFrame:
    return shipping.ship_performance(frames.store_shipping(data))


@query
def ship_trend(data: Retail) -> DataFrame:
    return shipping.ship_trend(shipping.ship_performance(frames.store_shipping(data)))


# Cube over the general sales warehouse


@query
def cube_kpi(data: Retail) -> DataFrame:
    return cube.cube_kpi(cube.with_margin(frames.warehouse_costed(data)))


@query
def cube_top_products(data: Retail) -> DataFrame:
    return cube.top_revenue(frames.warehouse_by_product(data), "product_name_product")


@query
def cube_top_cities(data: Retail) -> DataFrame:
    return cube.top_revenue(frames.warehouse_by_customer(data), "city_customer")


@query
def cube_category_sales(data: Retail) -> DataFrame:
    return cube.revenue_by(frames.warehouse_by_product(data), "category_product")


@query
def cube_month_financial(data: Retail) -> DataFrame:
    return cube.month_financial(frames.warehouse_by_day(data))


@query
def cube_summary(data: Retail) -> DataFrame:
    return cube.cube_summary(frames.warehouse_places(data), "category_product", "city_customer")


@query
def lattice_slice_kpi(data: Retail) -> DataFrame:
    """From stored cuboids, as are the next three."""
    return frames.warehouse_lattice(data).slice(**SLICE).kpi()


@query
def lattice_top_products(data: Retail) -> DataFrame:
    return frames.warehouse_lattice(data).slice().top_products()


@query
def lattice_month_financial(data: Retail) -> DataFrame:
    return frames.warehouse_lattice(data).slice().months()


@query
def lattice_summary(data: Retail) -> DataFrame:
    return frames.warehouse_lattice(data).slice().summary()


# Cube over the bike shop


@query
def cube_a_kpi(data: Retail) -> DataFrame:
    return cube.cube_kpi(cube.with_margin(frames.shop_costed(data)))


@query
def cube_a_top_products(data: Retail) -> DataFrame:
    return cube.top_revenue(frames.shop_by_product(data), "product_name_product")


@query
def cube_a_top_cities(data: Retail) -> DataFrame:
    return cube.top_revenue(frames.shop_by_customer(data), "customer_city_customer")


@query
def cube_a_category_sales(data: Retail) -> DataFrame:
    return cube.revenue_by(frames.shop_by_product(data), "category_name_category")


@query
def cube_a_month_financial(data: Retail) -> DataFrame:
    return cube.month_financial(frames.shop_by_day(data))


@query
def cube_a_summary(data: Retail) -> DataFrame:
    return cube.cube_summary(
        frames.shop_places(data), "category_name_category", "customer_city_customer"
    )
