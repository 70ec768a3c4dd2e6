"""The driver's order tables seen as the two retail stars.

A line of an order is a sale, its supplier the seller, and the seller's nation the store. The
order holds the date and the customer of its lines, the part holds their price. Every method
returns a lazy frame of one table (nations and regions aside), so that a plan joins what it needs
at the grain it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.functions.measures import with_line_count
from saleslens.sources.parquet import open_table
from saleslens.sources.schemas import SHOP_TABLES


def table(build: Callable[[Retail], DataFrame]) -> Callable[[Retail], DataFrame]:
    """A table frame that is planned once per ``Retail``; still lazy, it holds no data."""

    @wraps(build)
    def planned(self: Retail) -> DataFrame:
        if build.__name__ not in self.frames:
            self.frames[build.__name__] = build(self)
        return self.frames[build.__name__]

    return planned


WAREHOUSE_KEYS = {"product_id": "product_key", "staff_id": "employee_key"}


def _whole(column: str) -> Column:
    """A count of units, which these tables have whole; a fraction is an error, not cut off."""
    stored = F.col(column)
    message = F.concat(F.lit(f"{column} is not whole: "), stored.cast("string"))
    return F.when(stored.isNull() | (F.rint(stored) == stored), stored.cast("int")).otherwise(F.raise_error(message))


def _charges() -> dict[str, Column]:
    net = F.col("gross_amount") * (1 - F.col("discount"))
    return {"net_amount": net, "taxes": net * F.col("tax")}


def with_charges(sales: DataFrame) -> DataFrame:
    """Net amount and taxes of the gross amount and its rates, in place of those that ``sales`` has.
    A plan that makes them anew after its joins moves two rates of few values and not two amounts."""
    return sales.withColumns(_charges())


def with_amounts(lines: DataFrame, *rates: str) -> DataFrame:
    """Stored lines, joined or not, with their sale keys and amounts; other columns stay, the tax rate
    if ``rates`` names it."""
    own = ("order_id", "product_id", "staff_id", "quantity", "discount", *rates, "shipped_date", "gross_amount")
    return lines.select(
        (F.col("order_id") * 10 + F.col("line_number")).alias("sale_id"),
        *own,
        *(amount.alias(name) for name, amount in _charges().items()),
        F.lit(None).cast("double").alias("shipping_fee"),
        *(name for name in lines.columns if name not in (*own, "line_number", "tax")),
    )


class Retail:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self.frames: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        return open_table(self.spark, f"{self.path}/{name}.parquet")

    @table
    def lines(self) -> DataFrame:
        """Sales without what the order or the part know about them."""
        return with_line_count(with_amounts(self.stored_lines()))

    @table
    def stored_lines(self) -> DataFrame:
        """Sales as the lines are stored, before ``with_amounts``: rates and line numbers take less
        room in a shuffle than the amounts and the sale keys made of them."""
        return self._table("lineitem").select(
            F.col("l_linenumber").alias("line_number"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("staff_id"),
            _whole("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
            F.col("l_shipdate").alias("shipped_date"),
            F.col("l_extendedprice").alias("gross_amount"),
            F.col("l_tax").alias("tax"),
        )

    @table
    def orders(self) -> DataFrame:
        return self._table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_date"),
        )

    @table
    def prices(self) -> DataFrame:
        return self.products().select("product_id", "list_price")

    @table
    def products(self) -> DataFrame:
        """Products with their brand and category names at hand, as the part table stores them.

        The category key is a hash of its name, of 60 bits: the same on every machine and in every
        engine, without numbering the categories first.
        """
        return self._table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.substring_index("p_brand", "#", -1).try_cast("int").alias("brand_id"),
            F.conv(F.substring(F.md5("p_type"), 1, 15), 16, 10).cast("bigint").alias("category_id"),
            F.col("p_retailprice").alias("list_price"),
            F.col("p_brand").alias("brand_name"),
            F.col("p_type").alias("category_name"),
        )

    @table
    def snowflake_products(self) -> DataFrame:
        """Products that know only the keys of their brand and category."""
        return self.products().drop("brand_name", "category_name")

    @table
    def brands(self) -> DataFrame:
        return self.products().select("brand_id", "brand_name").distinct()

    @table
    def categories(self) -> DataFrame:
        return self.products().select("category_id", "category_name").distinct()

    @table
    def stores(self) -> DataFrame:
        return self._table("nation").select(
            F.col("n_nationkey").alias("store_id"), F.col("n_name").alias("store_name")
        )

    @table
    def staffs(self) -> DataFrame:
        return self._table("supplier").select(
            F.col("s_suppkey").alias("staff_id"),
            F.col("s_name").alias("staff_fullname"),
            F.col("s_nationkey").alias("store_id"),
        )

    @table
    def buyers(self) -> DataFrame:
        """Customers with the key of their nation, before it is resolved."""
        return self._table("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_fullname"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation_id"),
        )

    @table
    def states(self) -> DataFrame:
        return self._table("nation").select(
            F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("state")
        )

    @table
    def places(self) -> DataFrame:
        """States with the region they are in."""
        region = self._table("region").select(
            F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("country_region")
        )
        nation = self._table("nation").join(region, "n_regionkey", "left")
        return nation.select(
            F.col("n_nationkey").alias("nation_id"),
            F.col("n_name").alias("state"),
            "country_region",
        )

    @table
    def customers(self) -> DataFrame:
        return self.with_home(self.buyers()).select(
            "customer_id", "customer_fullname", "customer_city", "customer_state"
        )

    def with_home(self, df: DataFrame) -> DataFrame:
        """State and city of the buyer columns in ``df``."""
        city = F.concat("state", F.lit(" "), "segment")
        return (
            df.join(self.states(), "nation_id", "left")
            .withColumn("customer_city", city)
            .withColumnRenamed("state", "customer_state")
            .drop("nation_id", "segment")
        )

    @table
    def dates(self) -> DataFrame:
        """Calendar of the days with orders."""
        day = F.col("date_key")
        return (
            self._table("orders")
            .select(F.col("o_orderdate").cast("date").alias("date_key"))
            .filter(day.isNotNull())
            .distinct()
            .select(
                day,
                F.year(day).alias("year"),
                F.quarter(day).alias("quarter"),
                F.month(day).alias("month"),
                F.date_format(day, "MMMM").alias("month_name"),
            )
        )

    def shop(self) -> dict[str, DataFrame]:
        """The bike-shop star as tables of their own, as ``load_shop`` gives them."""
        sellers = self.staffs().select("staff_id", "store_id")
        fact = self.stored_lines().join(self.prices(), "product_id", "left")
        fact = fact.join(sellers, "staff_id", "left").join(self.orders(), "order_id", "left")
        return {
            "fact_sales": with_amounts(fact),
            "dim_date": self.dates(),
            "dim_customers": self.customers(),
            "dim_staffs": self.staffs(),
            "dim_products": self.snowflake_products(),
            "dim_brands": self.brands(),
            "dim_categories": self.categories(),
            "dim_stores": self.stores(),
        }

    def write_shop(self, path: str) -> None:
        """The shop star as Parquet tables with all declared columns, for ``load_shop``; what these
        tables don't know is null."""
        for name, df in self.shop().items():
            columns = [
                (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
                for c, kind in SHOP_TABLES[name].items()
            ]
            df.select(*columns).write.parquet(f"{path}/{name}.parquet")

    def warehouse(self) -> dict[str, DataFrame]:
        """The general sales star as tables of their own, as ``load_warehouse`` gives them; the fact
        keeps the rates that ``with_charges`` reads."""
        home = self.places()
        city = F.concat("state", F.lit(" "), "segment")
        customers = self.buyers().join(home, "nation_id", "left").select(
            "customer_id",
            F.col("customer_fullname").alias("company_name"),
            city.alias("city"),
            "country_region",
            F.col("state").alias("state_province"),
        )
        sellers = self.staffs().withColumnRenamed("store_id", "nation_id")
        employees = sellers.join(home, "nation_id", "left").select(
            F.col("staff_id").alias("employee_key"),
            F.col("staff_fullname").alias("full_name"),
            F.col("state").alias("city"),
            "country_region",
        )
        dated = self.stored_lines().join(self.warehouse_orders(), "order_id", "left")
        fact = with_line_count(with_amounts(dated, "tax"))
        return {
            "fact_sales": fact.withColumnsRenamed(WAREHOUSE_KEYS),
            "dim_date": self.dates(),
            "dim_customers": customers,
            "dim_employees": employees,
            "dim_products": self.warehouse_products(),
        }

    # The same tables under the names of the general sales warehouse.

    @table
    def warehouse_lines(self) -> DataFrame:
        return self.lines().withColumnsRenamed(WAREHOUSE_KEYS)

    @table
    def warehouse_orders(self) -> DataFrame:
        return self.orders().select(
            "order_id",
            F.col("customer_id").alias("customer_key"),
            F.col("order_date").cast("date").alias("order_date_key"),
        )

    @table
    def warehouse_products(self) -> DataFrame:
        return self.products().select(
            F.col("product_id").alias("product_key"),
            "product_name",
            F.col("category_name").alias("category"),
            F.col("list_price").alias("standard_cost"),
            "list_price",
        )


def retail(spark: SparkSession, path: str) -> Retail:
    """The tables under ``path``, as their files are now."""
    return Retail(spark, path)
