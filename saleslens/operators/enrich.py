"""Left joins that add dimension columns to sales.

A fact row without a match keeps its measures and gets null attributes. A repeated dimension key
multiplies its sales; ``quality.repeated_keys`` finds those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("product", "store", "customer")


def product_dimension(
    products: DataFrame,
    categories: DataFrame | None = None,
    brands: DataFrame | None = None,
    *extras: str,
) -> DataFrame:
    """Products with their category and brand names, and the product columns in ``extras``.

    The snowflake is folded on the product side, once per product rather than once per sale.
    Products that already carry the names pass through unchanged.
    """
    wide = products
    if "category_name" not in wide.columns and categories is not None:
        wide = wide.join(categories.select("category_id", "category_name"), "category_id", "left")
    if "brand_name" not in wide.columns and brands is not None:
        wide = wide.join(brands.select("brand_id", "brand_name"), "brand_id", "left")
    names = ("product_id", "product_name", "category_name", "brand_name", *extras)
    return wide.select([name for name in names if name in wide.columns])


def with_products(sales: DataFrame, product_dim: DataFrame) -> DataFrame:
    return sales.join(product_dim, "product_id", "left")


def with_stores(sales: DataFrame, stores: DataFrame) -> DataFrame:
    return sales.join(stores.select("store_id", "store_name"), "store_id", "left")


def with_customer_geo(sales: DataFrame, customers: DataFrame) -> DataFrame:
    geo = customers.select("customer_id", "customer_city", "customer_state")
    return sales.join(geo, "customer_id", "left")


def with_staff_names(sales: DataFrame, staffs: DataFrame) -> DataFrame:
    return sales.join(staffs.select("staff_id", "staff_fullname"), "staff_id", "left")


def enrich(
    sales: DataFrame, tables: dict[str, DataFrame], dims: tuple[str, ...] = DIMENSIONS
) -> DataFrame:
    """Join the dimensions a report asks for; a dimension nobody reads costs a join for nothing."""
    unknown = set(dims) - set(DIMENSIONS)
    if unknown:
        raise ValueError(f"unknown dimensions: {', '.join(sorted(unknown))}")
    if "product" in dims:
        product_dim = product_dimension(
            tables["dim_products"], tables.get("dim_categories"), tables.get("dim_brands")
        )
        sales = with_products(sales, product_dim)
    if "store" in dims:
        sales = with_stores(sales, tables["dim_stores"])
    if "customer" in dims:
        sales = with_customer_geo(sales, tables["dim_customers"])
    return sales


def suffixed(dim: DataFrame, suffix: str) -> DataFrame:
    """Every column renamed to end in ``suffix``, so that joined dimensions cannot clash."""
    return dim.select([F.col(name).alias(f"{name}{suffix}") for name in dim.columns])


def attach(fact: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Left join on keys that have different names on the two sides."""
    return fact.join(dim, F.col(key) == F.col(dim_key), "left")
