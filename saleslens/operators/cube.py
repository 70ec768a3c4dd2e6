"""Sales cube: the wide denormalised frame of a star, its KPIs and its summaries.

Two stars feed the same reports. In the *warehouse* star a product knows its category and its
unit cost, and an order value adds shipping and taxes. In the *shop* star the category is a table
of its own, a unit costs its list price, and the order value is the net amount.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.functions.bitmaps import by_word, keys_in
from saleslens.functions.measures import with_cube_amounts, with_margin
from saleslens.functions.numeric import (
    half_even_cents,
    published,
    published_total,
    ratio,
    six_places,
    total,
    with_known,
)
from saleslens.functions.periods import with_time_hierarchy
from saleslens.operators.enrich import attach, suffixed

TOP = 10

# The dimension columns that enter the cubes.
WAREHOUSE_CUSTOMER = ("customer_id", "company_name", "city", "country_region", "state_province")
WAREHOUSE_EMPLOYEE = ("employee_key", "full_name", "job_title", "city", "country_region")
WAREHOUSE_PRODUCT = ("product_key", "product_name", "category", "standard_cost", "list_price")
SHOP_CUSTOMER = (
    "customer_id",
    "first_name",
    "last_name",
    "customer_fullname",
    "customer_phone",
    "customer_email",
    "customer_street",
    "customer_city",
    "customer_state",
    "customer_zipcode",
)
SHOP_STAFF = (
    "staff_id",
    "staff_fullname",
    "staff_email",
    "staff_phone",
    "staff_active",
    "store_id",
    "manager_id",
)
SHOP_PRODUCT = ("product_id", "product_name", "brand_id", "category_id", "model_year", "list_price")
SHOP_BRAND = ("brand_id", "brand_name")
SHOP_CATEGORY = ("category_id", "category_name")
SHOP_STORE = (
    "store_id",
    "store_name",
    "store_phone",
    "store_email",
    "store_street",
    "store_city",
    "store_state",
    "store_zip_code",
)


def with_calendar(fact: DataFrame, dates: DataFrame, key: str) -> DataFrame:
    """Calendar columns of the day in ``key``. A calendar has a row per day however many the sales
    are, so it is sent to every task and no sale is moved for it."""
    return attach(fact, F.broadcast(suffixed(dates, "_date")), key, "date_key_date")


def _part(dim: DataFrame, columns: tuple[str, ...], suffix: str) -> DataFrame:
    return suffixed(dim.select(*[c for c in columns if c in dim.columns]), suffix)


def with_warehouse_customer(fact: DataFrame, customers: DataFrame) -> DataFrame:
    part = _part(customers, WAREHOUSE_CUSTOMER, "_customer")
    return attach(fact, part, "customer_key", "customer_id_customer")


def with_warehouse_employee(fact: DataFrame, employees: DataFrame) -> DataFrame:
    part = _part(employees, WAREHOUSE_EMPLOYEE, "_employee")
    return attach(fact, part, "employee_key", "employee_key_employee")


def with_warehouse_product(fact: DataFrame, products: DataFrame) -> DataFrame:
    part = _part(products, WAREHOUSE_PRODUCT, "_product")
    return attach(fact, part, "product_key", "product_key_product")


def with_warehouse_measures(cube: DataFrame) -> DataFrame:
    return with_cube_amounts(cube, "standard_cost_product", "shipping_fee", "taxes")


def warehouse_cube(
    fact: DataFrame,
    tables: dict[str, DataFrame],
    charged: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Fact with its calendar, customer, employee and product, measures and time keys.

    Every join moves what the joins before it have added: the widest comes last, and after it the
    calendar, which moves nothing. ``charged`` makes amounts of the fact anew from its other columns;
    they are then made after the joins and not moved.
    """
    wide = with_warehouse_product(fact, tables["dim_products"])
    wide = with_warehouse_employee(wide, tables["dim_employees"])
    wide = with_warehouse_customer(wide, tables["dim_customers"])
    wide = with_calendar(wide, tables["dim_date"], "order_date_key")
    wide = charged(wide) if charged else wide
    return with_time_hierarchy(with_margin(with_warehouse_measures(wide)))


def with_shop_customer(fact: DataFrame, customers: DataFrame) -> DataFrame:
    part = _part(customers, SHOP_CUSTOMER, "_customer")
    return attach(fact, part, "customer_id", "customer_id_customer")


def with_shop_staff(fact: DataFrame, staffs: DataFrame) -> DataFrame:
    return attach(fact, _part(staffs, SHOP_STAFF, "_staff"), "staff_id", "staff_id_staff")


def shop_product(products: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """Products with their brand and category, joined once per product."""
    wide = _part(products, SHOP_PRODUCT, "_product")
    wide = attach(wide, _part(brands, SHOP_BRAND, "_brand"), "brand_id_product", "brand_id_brand")
    return attach(
        wide,
        _part(categories, SHOP_CATEGORY, "_category"),
        "category_id_product",
        "category_id_category",
    )


def with_shop_product(fact: DataFrame, product_part: DataFrame) -> DataFrame:
    return attach(fact, product_part, "product_id", "product_id_product")


def with_shop_store(fact: DataFrame, stores: DataFrame) -> DataFrame:
    return attach(fact, _part(stores, SHOP_STORE, "_store"), "store_id", "store_id_store")


def with_shop_measures(cube: DataFrame) -> DataFrame:
    return with_cube_amounts(cube, "list_price_product")


def shop_cube(fact: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Fact with calendar, customer, staff, product, brand, category and store, the widest last."""
    product_part = shop_product(
        tables["dim_products"], tables["dim_brands"], tables["dim_categories"]
    )
    day = fact.withColumn("order_day", F.col("order_date").cast("date"))
    wide = with_shop_staff(day, tables["dim_staffs"])
    wide = with_shop_product(wide, product_part)
    wide = with_shop_customer(wide, tables["dim_customers"])
    wide = with_shop_store(wide, tables["dim_stores"])
    wide = with_calendar(wide, tables["dim_date"], "order_day").drop("order_day")
    return with_time_hierarchy(with_margin(with_shop_measures(wide)))


def cube_kpi(cube: DataFrame) -> DataFrame:
    """Totals, distinct sales, mean order value per row and mean of the row margins.

    Every figure of an empty slice is 0. One pass: sales are bits of words, and what is shuffled is
    a row per word with its sums.
    """
    return kpi_of_sums(by_word(cube, "sale_id", **sums()), keys_in())


def sums() -> dict[str, Column]:
    """What the KPI adds up over rows of the cube; cells of these can be added up again."""
    return {
        "revenue": F.sum("revenue"),
        "profit": F.sum("profit"),
        "order_value": F.sum("order_value"),
        "order_values": F.count("order_value"),
        "margin": F.sum("profit_margin"),
        "margins": F.count("profit_margin"),
        "quantity": F.sum("quantity"),
    }


def kpi_of_sums(cells: DataFrame, orders: Column) -> DataFrame:
    """The KPI over rows of ``sums``; ``orders`` counts the distinct sales of the cells."""
    return cells.agg(
        published(total("revenue")).alias("total_revenue"),
        published(total("profit")).alias("total_profit"),
        orders.alias("total_orders"),
        six_places(ratio(published(F.sum("order_value")), F.sum("order_values"))).alias("avg_order_value"),
        six_places(ratio(F.sum("margin"), F.sum("margins"))).alias("profit_margin"),
        total("quantity").cast("bigint").alias("total_quantity"),
    )


def top_revenue(cube: DataFrame, key: str, n: int = TOP) -> DataFrame:
    """The ``n`` products or cities with the largest revenue."""
    return (
        with_known(cube, key)
        .groupBy(key)
        .agg(total("revenue").alias("revenue"))
        .orderBy(F.desc("revenue"), key)
        .limit(n)
        .withColumn("revenue", published(F.col("revenue")))
    )


def revenue_by(cube: DataFrame, key: str) -> DataFrame:
    return with_known(cube, key).groupBy(key).agg(published_total("revenue"))


def month_financial(cube: DataFrame) -> DataFrame:
    """Revenue and profit per month name; the same month of all years is one row."""
    return (
        with_known(cube, "month_name_date")
        .groupBy("month_name_date")
        .agg(published_total("revenue"), published_total("profit"))
    )


def cube_summary(cube: DataFrame, category: str, city: str) -> DataFrame:
    """Revenue, profit, quantity and distinct sales per category and city, to two decimals."""
    parts = {name: F.sum(name) for name in ("revenue", "profit", "quantity")}
    words = by_word(with_known(cube, category, city), "sale_id", category, city, **parts)
    return summary_of_sums(words, category, city, keys_in())


def summary_of_sums(cells: DataFrame, category: str, city: str, sales: Column) -> DataFrame:
    return cells.groupBy(category, city).agg(
        half_even_cents(published(total("revenue"))).alias("revenue"),
        half_even_cents(published(total("profit"))).alias("profit"),
        total("quantity").cast("bigint").alias("quantity"),
        sales.alias("sales"),
    )
