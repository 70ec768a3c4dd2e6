"""Sales frames over the driver's tables, each at the coarsest grain its reports allow.

Which side of a join gets shrunk first decides what these reports cost at scale:

* By product the price is constant, so discounted units are summed before the part is joined:
  the fact is shuffled once, already combined, and a hot product is one row per scan task.
* By order, lines are summed before the order is joined; the join is one row to one row, and
  because it leaves the rows partitioned by order, the distinct orders of a period need no
  shuffle of their own.
* By seller, lines are summed before the supplier is joined.

Only reports that list or count single sales join dimensions to fact rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.functions.bins import Bins
from saleslens.functions.bitmaps import among, noted
from saleslens.functions.measures import (
    to_grain,
    with_discounted_units,
    with_net_sales,
    with_priced_units,
    with_revenue,
)
from saleslens.functions.numeric import with_known
from saleslens.functions.periods import with_period_columns, with_ship_lag
from saleslens.operators import cube, customers, enrich, filters, sales, shipping
from saleslens.plans import lattice, pages
from saleslens.sources import store
from saleslens.sources.retail import Retail, with_amounts


# A dimension made of two tables is joined one table at a time, never joined up first: Spark sizes
# a stored table well enough to broadcast a small one, but the result of a join only as the
# product of its sides, which it would rather shuffle the sales for.


def with_home(df: DataFrame, data: Retail) -> DataFrame:
    """City and state of ``customer_id``."""
    buyers = data.buyers().drop("customer_fullname")
    return data.with_home(df.join(buyers, "customer_id", "left"))


def with_staff_store(df: DataFrame, data: Retail) -> DataFrame:
    """Store name of ``staff_id``."""
    stores_of_staff = data.staffs().select("staff_id", "store_id")
    return enrich.with_stores(df.join(stores_of_staff, "staff_id", "left"), data.stores())


def priced_lines(data: Retail) -> DataFrame:
    """Fact rows with their list price and net sales."""
    return with_net_sales(data.lines().join(data.prices(), "product_id", "left"))


def star_lines(data: Retail, lines: DataFrame) -> DataFrame:
    """``lines`` with price, store, date and customer: the columns of a loaded star's fact."""
    sellers = data.staffs().select("staff_id", "store_id")
    priced = lines.join(data.prices(), "product_id", "left").join(sellers, "staff_id", "left")
    return priced.join(data.orders(), "order_id", "left")


def sold(data: Retail) -> tuple[DataFrame, DataFrame]:
    """The orders and the products that have sales; the sales are read once, into bitmaps."""
    words = store.stored(noted(data.lines(), "order_id", "product_id"))
    return among(data.orders(), "order_id", words, 0), among(data.products(), "product_id", words, 1)


def dated_lines(data: Retail) -> DataFrame:
    """Priced fact rows with the date and customer of their order."""
    return priced_lines(data).join(data.orders(), "order_id", "left")


def order_sales(data: Retail, priced: bool = True) -> DataFrame:
    """One row per order: summed measures, date and customer."""
    lines = priced_lines(data) if priced else data.lines().select("order_id", "line_count")
    return to_grain(lines, "order_id").join(data.orders(), "order_id", "left")


def period_sales(data: Retail) -> DataFrame:
    return with_period_columns(order_sales(data))


def sales_since(data: Retail, first: date | None) -> DataFrame:
    """One row per order from a day on, with its periods. Only lines of these orders are priced."""
    orders = filters.in_date_range(data.orders(), first).select("order_id", "order_date")
    lines = data.lines().join(orders, "order_id").join(data.prices(), "product_id", "left")
    return with_period_columns(to_grain(with_net_sales(lines), "order_id", "order_date"))


def latest_trend(data: Retail, period: str) -> DataFrame:
    """Sales of the last two periods that have any, and perhaps of some before them.

    The dates of the orders alone name the periods, and the first day of the second last bounds the
    scan of the orders. Where orders without lines leave fewer than two periods with sales, the range
    grows to twice as many. The driver sees one date per period; the result is a written table.
    """
    start = F.trunc(F.col("order_date").cast("date"), period)
    found = data.orders().select(start.alias("start")).filter("start IS NOT NULL").distinct().collect()
    starts = sorted((row.start for row in found), reverse=True)
    periods = 2
    while True:
        first = starts[:periods][-1] if starts else None
        trend = store.stored(sales.sales_trend(sales_since(data, first), period))
        if periods >= len(starts) or trend.count() >= 2:
            return trend
        periods *= 2


def kept_orders(data: Retail) -> DataFrame:
    """The page's sales at order grain, as a copy in buckets of the order."""
    return pages.kept_orders(pages.sales_frame(data.shop(), dims=()))


def product_sales(data: Retail) -> DataFrame:
    """One row per product, with its names and net sales."""
    units = with_discounted_units(data.lines()).select(
        "product_id", "quantity", "discounted_units"
    )
    products = data.products().drop("brand_id", "category_id")
    by_product = to_grain(units, "product_id").join(products, "product_id", "left")
    return with_priced_units(by_product)


def discount_sales(data: Retail, bins: Bins) -> DataFrame:
    """One row per product and discount range: quantity and net sales."""
    lines = with_discounted_units(data.lines())
    binned = lines.withColumn("bin", bins.ordinal(F.col("discount"))).select(
        "product_id", "bin", "quantity", "discounted_units"
    )
    by_product = to_grain(with_known(binned, "bin"), "product_id", "bin")
    return with_priced_units(by_product.join(data.prices(), "product_id", "left"))


def staff_sales(data: Retail) -> DataFrame:
    """One row per seller."""
    lines = priced_lines(data).select("staff_id", "net_sales")
    return to_grain(lines, "staff_id")


def named_staff_sales(data: Retail) -> DataFrame:
    return enrich.with_staff_names(staff_sales(data), data.staffs())


def named_staff_lines(data: Retail) -> DataFrame:
    """Fact rows with net sales and the seller's name, to sum and to count orders in one scan."""
    lines = priced_lines(data).select("staff_id", "order_id", "net_sales")
    return enrich.with_staff_names(lines, data.staffs())


def store_lines(data: Retail) -> DataFrame:
    """Fact rows with net sales and the store's name."""
    return with_staff_store(priced_lines(data).select("staff_id", "order_id", "net_sales"), data)


def store_order_lines(data: Retail) -> DataFrame:
    """Orders of the fact rows with the store's name, to count the orders of a store."""
    return with_staff_store(data.lines().select("staff_id", "order_id"), data)


def store_sales(data: Retail) -> DataFrame:
    return with_staff_store(staff_sales(data), data)


def customer_rows(data: Retail) -> DataFrame:
    """One row per customer with sales: fact rows, city and state."""
    counted = customers.rows_per_customer(order_sales(data, priced=False))
    return with_home(counted, data)


def customer_orders(data: Retail) -> DataFrame:
    """One row per customer with sales: distinct orders, city and state."""
    counted = customers.orders_per_customer(order_sales(data, priced=False))
    return with_home(counted, data)


def ship_lags(data: Retail) -> DataFrame:
    """Fact rows with their days from order to shipping."""
    lines = data.lines().select("sale_id", "order_id", "staff_id", "shipped_date")
    return with_ship_lag(lines.join(data.orders(), "order_id", "left"))


def store_shipping(data: Retail) -> DataFrame:
    """Shipping totals per seller, with the store's name."""
    totals = shipping.shipping_totals(ship_lags(data), "staff_id")
    return with_staff_store(totals, data)


def named_lines(data: Retail) -> DataFrame:
    """Fact rows with store and product names, priced by the same join with the product."""
    product_dim = enrich.product_dimension(data.products(), None, None, "list_price")
    lines = with_staff_store(data.lines(), data)
    return with_net_sales(enrich.with_products(lines, product_dim))


def enriched_lines(data: Retail) -> DataFrame:
    """Fact rows with every dimension of the sales page.

    The customer is joined to the orders, not to their lines: the same result with a quarter of
    the rows to move. The widest columns join last, so that they are moved least.
    """
    headers = with_home(data.orders(), data)
    return named_lines(data).join(headers, "order_id", "left")


# Cube over the general sales warehouse.


def warehouse_costed(data: Retail) -> DataFrame:
    """Fact rows with their product and the additive cube amounts."""
    wide = cube.with_warehouse_product(data.warehouse_lines(), data.warehouse_products())
    return cube.with_warehouse_measures(wide)


def with_warehouse_home(df: DataFrame, data: Retail, region: bool = False) -> DataFrame:
    """Customer columns of the cube for ``customer_key``, with the region only if it is read."""
    buyers = data.buyers().select(
        F.col("customer_id").alias("customer_key"),
        F.col("customer_fullname").alias("company_name_customer"),
        "segment",
        "nation_id",
    )
    places = (data.places() if region else data.states()).withColumnsRenamed(
        {"state": "state_province_customer", "country_region": "country_region_customer"}
    )
    city = F.concat("state_province_customer", F.lit(" "), "segment")
    placed = df.join(buyers, "customer_key", "left").join(places, "nation_id", "left")
    return placed.withColumn("city_customer", city).drop("nation_id", "segment")


def with_warehouse_seller(df: DataFrame, data: Retail) -> DataFrame:
    """Employee columns of the cube for ``employee_key``."""
    sellers = data.staffs().select(
        F.col("staff_id").alias("employee_key"),
        F.col("staff_fullname").alias("full_name_employee"),
        F.col("store_id").alias("nation_id"),
    )
    places = data.states().withColumnRenamed("state", "city_employee")
    placed = df.join(sellers, "employee_key", "left").join(places, "nation_id", "left")
    return placed.drop("nation_id")


def warehouse_headers(data: Retail) -> DataFrame:
    """Orders with their calendar and customer columns."""
    headers = cube.with_calendar(data.warehouse_orders(), data.dates(), "order_date_key")
    return with_warehouse_home(headers, data, region=True)


def warehouse_by_product(data: Retail) -> DataFrame:
    """Cube revenue, one row per product."""
    lines = with_revenue(data.warehouse_lines()).select("product_key", "revenue")
    return cube.with_warehouse_product(to_grain(lines, "product_key"), data.warehouse_products())


def _by_customer(data: Retail) -> DataFrame:
    lines = with_revenue(data.lines()).select("order_id", "revenue")
    orders = to_grain(lines, "order_id").join(data.orders(), "order_id", "left")
    return to_grain(orders, "customer_id")


def warehouse_by_customer(data: Retail) -> DataFrame:
    """Cube revenue, one row per customer."""
    summed = _by_customer(data).withColumnRenamed("customer_id", "customer_key")
    return with_warehouse_home(summed, data)


def _by_day(data: Retail, costed: DataFrame) -> DataFrame:
    orders = to_grain(costed.select("order_id", "revenue", "profit"), "order_id")
    dated = orders.join(data.warehouse_orders(), "order_id", "left")
    return cube.with_calendar(to_grain(dated, "order_date_key"), data.dates(), "order_date_key")


def warehouse_by_day(data: Retail) -> DataFrame:
    """Cube revenue and profit, one row per day."""
    return _by_day(data, warehouse_costed(data))


def warehouse_rows(data: Retail) -> DataFrame:
    """The whole cube, one row per sale."""
    wide = with_warehouse_seller(data.warehouse_lines(), data)
    wide = cube.with_warehouse_product(wide, data.warehouse_products())
    wide = wide.join(warehouse_headers(data), "order_id", "left")
    return cube.with_time_hierarchy(cube.with_margin(cube.with_warehouse_measures(wide)))


def warehouse_slice(
    data: Retail,
    year: int | None = None,
    quarter: int | None = None,
    month: int | None = None,
    city: str | None = None,
    category: str | None = None,
    home: bool = True,
) -> DataFrame:
    """The rows of the cube that a slice keeps, with calendar, product and, if ``home`` or a city is
    asked for, customer columns.

    The calendar slicers also narrow the orders' own dates, which is what their scan can prune by.
    """
    days = filters.calendar_range(year, quarter, month)
    headers = filters.in_date_range(data.orders(), *days)
    headers = headers.select(
        "order_id",
        F.col("customer_id").alias("customer_key"),
        F.col("order_date").cast("date").alias("order_date_key"),
    )
    headers = cube.with_calendar(headers, data.dates(), "order_date_key")
    if home or city is not None:
        headers = with_warehouse_home(headers, data)
    how = "left" if days == (None, None) else "inner"
    wide = cube.with_warehouse_product(data.warehouse_lines(), data.warehouse_products())
    wide = wide.join(headers, "order_id", how)
    wide = cube.with_time_hierarchy(cube.with_margin(cube.with_warehouse_measures(wide)))
    return filters.slice_cube(wide, year, quarter, month, city, category)


def warehouse_places(data: Retail) -> DataFrame:
    """Fact rows with category, city and amounts: what the summary and its sales counts read."""
    headers = data.warehouse_orders().select("order_id", "customer_key")
    cities = with_warehouse_home(headers, data).select("order_id", "city_customer")
    return warehouse_costed(data).join(cities, "order_id", "left")


def warehouse_sales(data: Retail) -> DataFrame:
    """The rows of the cube as the join with their orders leaves them: dealt by order and, without
    one, strewn. Lines are moved as they are stored and amounts made of them afterwards."""
    sold = F.col("order_id").isNotNull()
    lines = data.stored_lines()
    strewn = F.when(sold, 0).otherwise(F.hash("line_number", "product_id", "staff_id", "shipped_date", "gross_amount"))
    lines = lines.withColumn(lattice.STREWN, strewn).withColumnRenamed("product_id", "product_key")
    lines = cube.with_warehouse_product(lines, data.warehouse_products())
    headers = cube.with_calendar(data.warehouse_orders(), data.dates(), "order_date_key")
    headers = with_warehouse_home(headers, data).withColumn(lattice.STREWN, F.when(sold, 0))
    wide = lines.withColumnRenamed("product_key", "product_id").join(headers, ["order_id", lattice.STREWN], "left")
    return cube.with_warehouse_measures(with_amounts(wide))


def warehouse_lattice(data: Retail) -> lattice.Lattice:
    """The cube's cuboids, written to the shared folder.

    With line numbers of one digit the rows of a sale have their order in common, and stay where the
    join with the orders has put them; others are dealt by word.
    """
    beyond = data.stored_lines().filter(~F.col("line_number").between(0, 9))
    dealt = ("order_id", lattice.STREWN) if beyond.isEmpty() else ()
    return lattice.build(warehouse_sales(data), lattice.WAREHOUSE, store.new_path(data.spark), dealt)


# Cube over the bike shop.


def shop_products(data: Retail) -> DataFrame:
    """Products under the cube's names, with the brand and category names they already carry."""
    return data.products().select(
        F.col("product_id").alias("product_id_product"),
        F.col("product_name").alias("product_name_product"),
        F.col("list_price").alias("list_price_product"),
        F.col("brand_name").alias("brand_name_brand"),
        F.col("category_name").alias("category_name_category"),
    )


def with_shop_home(df: DataFrame, data: Retail) -> DataFrame:
    """Customer columns of the cube for ``customer_id``."""
    located = data.with_home(df.join(data.buyers(), "customer_id", "left"))
    names = ("customer_fullname", "customer_city", "customer_state")
    return located.withColumnsRenamed({name: f"{name}_customer" for name in names})


def shop_costed(data: Retail) -> DataFrame:
    wide = cube.with_shop_product(data.lines(), shop_products(data))
    return cube.with_shop_measures(wide)


def shop_by_product(data: Retail) -> DataFrame:
    lines = with_revenue(data.lines()).select("product_id", "revenue")
    return cube.with_shop_product(to_grain(lines, "product_id"), shop_products(data))


def shop_by_customer(data: Retail) -> DataFrame:
    return with_shop_home(_by_customer(data), data)


def shop_by_day(data: Retail) -> DataFrame:
    return _by_day(data, shop_costed(data))


def shop_headers(data: Retail) -> DataFrame:
    day = data.orders().withColumn("order_day", F.col("order_date").cast("date"))
    headers = cube.with_calendar(day, data.dates(), "order_day").drop("order_day")
    return with_shop_home(headers, data)


def shop_rows(data: Retail) -> DataFrame:
    """The whole cube, one row per sale."""
    stores = data.stores().select(
        F.col("store_id").alias("store_id_store"), F.col("store_name").alias("store_name_store")
    )
    wide = cube.with_shop_staff(data.lines(), data.staffs())
    wide = enrich.attach(wide, stores, "store_id_staff", "store_id_store")
    wide = cube.with_shop_product(wide, shop_products(data))
    wide = wide.join(shop_headers(data), "order_id", "left")
    return cube.with_time_hierarchy(cube.with_margin(cube.with_shop_measures(wide)))


def shop_places(data: Retail) -> DataFrame:
    headers = with_shop_home(data.orders().select("order_id", "customer_id"), data)
    cities = headers.select("order_id", "customer_city_customer")
    return shop_costed(data).join(cities, "order_id", "left")
