"""DuckDB twins of the registered queries.

Each is written over single order lines with every dimension joined, not over the grains the
Spark plans use, so that the comparison also checks those.
"""

from __future__ import annotations

SALES = """
places AS (
  SELECT n_nationkey, n_name, r_name
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
),
sales AS (
  SELECT l_orderkey * 10 + l_linenumber AS sale_id,
         l_orderkey AS order_id,
         o_custkey AS customer_id,
         l_partkey AS product_id,
         l_suppkey AS staff_id,
         CAST(o_orderdate AS DATE) AS order_date,
         CAST(l_shipdate AS DATE) AS shipped_date,
         date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag_days,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(p_retailprice AS DECIMAL(14,4)) AS list_price,
         CAST(l_discount AS DECIMAL(6,4)) AS discount,
         CAST(l_quantity AS DECIMAL(12,2)) * CAST(p_retailprice AS DECIMAL(14,4))
           * (1 - CAST(l_discount AS DECIMAL(6,4))) AS net_sales,
         CAST(l_extendedprice AS DECIMAL(16,4)) AS gross_amount,
         CAST(l_extendedprice AS DECIMAL(16,4)) * (1 - CAST(l_discount AS DECIMAL(6,4)))
           AS net_amount,
         CAST(l_tax AS DECIMAL(6,4)) AS tax_rate,
         p_name AS product_name,
         p_brand AS brand_name,
         p_type AS category_name,
         s_name AS staff_fullname,
         sp.n_name AS store_name,
         sp.r_name AS store_region,
         c_name AS customer_fullname,
         cp.n_name AS customer_state,
         cp.r_name AS customer_region,
         cp.n_name || ' ' || c_mktsegment AS customer_city
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN places sp ON s_nationkey = sp.n_nationkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN places cp ON c_nationkey = cp.n_nationkey
)"""

RANKED = """SELECT field, value, CAST(row_number() OVER (
  PARTITION BY field ORDER BY try_cast(value AS DOUBLE) NULLS LAST, value) AS INTEGER) AS rank
FROM ({})"""

CUBE = (
    SALES
    + """,
amounts AS (
  SELECT *,
         net_amount AS revenue,
         gross_amount AS gross_revenue,
         gross_amount - net_amount AS discount_amount,
         quantity * coalesce(list_price, 0) AS total_cost,
         net_amount - quantity * coalesce(list_price, 0) AS profit,
         net_amount + net_amount * tax_rate AS order_value_b,
         net_amount AS order_value_a,
         CAST(year(order_date) AS INTEGER) AS year_date,
         CAST(quarter(order_date) AS INTEGER) AS quarter_date,
         CAST(month(order_date) AS INTEGER) AS month_date,
         strftime(order_date, '%Y-%m') AS year_month,
         year(order_date) || '-Q' || quarter(order_date) AS year_quarter,
         monthname(order_date) AS month_name_date
  FROM sales
),
cube AS (
  SELECT *,
         CASE WHEN profit IS NULL OR net_amount IS NULL THEN 0
              WHEN net_amount = 0 THEN CASE WHEN profit > 0 THEN CAST('inf' AS DOUBLE)
                                            WHEN profit < 0 THEN CAST('-inf' AS DOUBLE)
                                            ELSE 0 END
              ELSE CAST(profit AS DOUBLE) / CAST(net_amount AS DOUBLE) * 100
         END AS margin
  FROM amounts
)"""
)


def _sales(body: str) -> str:
    return f"WITH {SALES.strip()}\n{body.strip()}"


def _cube(body: str) -> str:
    return f"WITH {CUBE.strip()}\n{body.strip()}"


def _dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _amounts(order_value: str) -> str:
    return f"""
      CAST(revenue AS DOUBLE) AS revenue, CAST(gross_revenue AS DOUBLE) AS gross_revenue,
      CAST(discount_amount AS DOUBLE) AS discount_amount, CAST(total_cost AS DOUBLE) AS total_cost,
      CAST(profit AS DOUBLE) AS profit, CAST({order_value} AS DOUBLE) AS order_value,
      round(margin, 6) AS profit_margin"""


def _trend(period: str) -> str:
    return f"""
      SELECT {period} AS period, sum(net_sales) AS net_sales, count(DISTINCT order_id) AS orders
      FROM sales WHERE order_date IS NOT NULL GROUP BY 1"""


PERIOD = {
    "month": "strftime(order_date, '%Y-%m')",
    "quarter": "year(order_date) || 'Q' || quarter(order_date)",
    "year": "CAST(year(order_date) AS INTEGER)",
}


def _trend_sql(name: str) -> str:
    return _sales(
        f"""SELECT period AS {name}, {_dbl('net_sales')} AS net_sales, orders
        FROM ({_trend(PERIOD[name])}) t"""
    )


def _growth_sql(name: str) -> str:
    return _sales(
        f"""
        SELECT CASE WHEN count(*) = 2 THEN round(
                 (max(s) FILTER (WHERE rn = 1) - max(s) FILTER (WHERE rn = 2))
                 / nullif(max(s) FILTER (WHERE rn = 2), 0), 6) END AS sales_growth,
               CASE WHEN count(*) = 2 THEN round(
                 (max(o) FILTER (WHERE rn = 1) - max(o) FILTER (WHERE rn = 2))
                 / nullif(max(o) FILTER (WHERE rn = 2), 0), 6) END AS orders_growth
        FROM (SELECT {_dbl('net_sales')} AS s, {_dbl('orders')} AS o,
                     row_number() OVER (ORDER BY period DESC) AS rn
              FROM ({_trend(PERIOD[name])}) t) r
        WHERE rn <= 2"""
    )


def _top(measure: str, keys: str) -> str:
    kind = "BIGINT" if measure == "quantity" else "DOUBLE"
    first = keys.split(", ")[0]
    known = " AND ".join(f"{key} IS NOT NULL" for key in keys.split(", "))
    return _sales(
        f"""SELECT {keys}, CAST(coalesce(sum({measure}), 0) AS {kind}) AS {measure}
        FROM sales WHERE {known} GROUP BY {keys}
        ORDER BY coalesce(sum({measure}), 0) DESC, {first} LIMIT 10"""
    )


def _bins(edges: list[str], labels: list[str], low: str, high: str) -> str:
    values = ", ".join(
        f"({position}, '{label}', {start}, {end})"
        for position, (label, start, end) in enumerate(zip(labels, edges, edges[1:]))
    )
    return _sales(
        f"""SELECT CAST(b.bin AS INTEGER) AS bin, b.discount_range,
               CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_qty,
               CAST(coalesce(sum(net_sales), 0) AS DOUBLE) AS total_sales
        FROM (VALUES {values}) b(bin, discount_range, lo, hi)
        LEFT JOIN sales ON discount {low} b.lo AND discount {high} b.hi
        GROUP BY 1, 2"""
    )


def _by_rows(place: str) -> str:
    return f"""
      SELECT {place}, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders,
             round(CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) / count(*), 6) AS repeat_rate,
             count(*) FILTER (WHERE n > 1) AS repeat_customers,
             count(*) FILTER (WHERE n <= 1) AS non_repeat_customers
      FROM (SELECT {place}, customer_id, count(order_id) AS n FROM sales
            WHERE {place} IS NOT NULL AND customer_id IS NOT NULL GROUP BY 1, 2) c
      GROUP BY 1"""


def _by_orders(place: str) -> str:
    return f"""
      SELECT {place},
             round(CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) / count(*), 6) AS repeat_rate,
             count(DISTINCT customer_id) AS customers
      FROM (SELECT {place}, customer_id, count(DISTINCT order_id) AS n FROM sales
            WHERE {place} IS NOT NULL AND customer_id IS NOT NULL GROUP BY 1, 2) c
      GROUP BY 1"""


LARGEST = f"""
  SELECT greatest(1, coalesce(max(customers), 1)) AS max_cust
  FROM (SELECT customers FROM ({_by_orders('customer_city')}) x
        UNION ALL SELECT customers FROM ({_by_orders('customer_state')}) y) z"""


def _performance(name: str) -> str:
    return f"""
      SELECT {name}, CAST(coalesce(sum(net_sales), 0) AS DOUBLE) AS net_sales,
             count(DISTINCT order_id) AS orders
      FROM sales WHERE {name} IS NOT NULL GROUP BY 1"""


SHIPPING = """
  SELECT store_name,
         round(CAST(sum(lag_days) AS DOUBLE) / nullif(count(lag_days), 0), 6) AS avg_days,
         round(CAST(count(*) FILTER (WHERE lag_days <= 0) AS DOUBLE) / count(*), 6) AS on_time_rate
  FROM sales WHERE store_name IS NOT NULL GROUP BY 1"""


def _kpi(order_value: str, where: str = "") -> str:
    return _cube(
        f"""
        SELECT CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS total_revenue,
               CAST(coalesce(sum(profit), 0) AS DOUBLE) AS total_profit,
               count(DISTINCT sale_id) AS total_orders,
               round(coalesce(CAST(sum({order_value}) AS DOUBLE)
                 / nullif(count({order_value}), 0), 0), 6) AS avg_order_value,
               round(coalesce(avg(margin), 0), 6) AS profit_margin,
               CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_quantity
        FROM cube {where}"""
    )


SLICE = "WHERE year_date = 1998 AND quarter_date = 1 AND category_name = 'ECONOMY'"


def _revenue_by(key: str, name: str, tail: str = "") -> str:
    return _cube(
        f"""SELECT {key} AS {name}, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue
        FROM cube WHERE {key} IS NOT NULL GROUP BY 1 {tail}"""
    )


TOP_REVENUE = "ORDER BY coalesce(sum(revenue), 0) DESC, 1 LIMIT 10"

MONTH_FINANCIAL = _cube(
    """SELECT month_name_date, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue,
           CAST(coalesce(sum(profit), 0) AS DOUBLE) AS profit
    FROM cube WHERE month_name_date IS NOT NULL GROUP BY 1"""
)


def _summary(category: str, city: str) -> str:
    return _cube(
        f"""SELECT category_name AS {category}, customer_city AS {city},
               round_even(CAST(coalesce(sum(revenue), 0) AS DOUBLE) * 100, 0) / 100 AS revenue,
               round_even(CAST(coalesce(sum(profit), 0) AS DOUBLE) * 100, 0) / 100 AS profit,
               CAST(coalesce(sum(quantity), 0) AS BIGINT) AS quantity,
               count(DISTINCT sale_id) AS sales
        FROM cube WHERE category_name IS NOT NULL AND customer_city IS NOT NULL GROUP BY 1, 2"""
    )


def _first_rows(table: str, columns: list[str], source: str) -> str:
    record = " || '|' || ".join(f"coalesce(CAST({column} AS VARCHAR), '-')" for column in columns)
    order = ", ".join(columns)
    return f"""
      (SELECT '{table}' AS table_name, {record} AS record FROM {source}
       ORDER BY {order} LIMIT 5)"""


CATEGORY_KEY = "CAST('0x' || substr(md5(p_type), 1, 15) AS BIGINT)"


def _audited(table: str, column: str, source: str, dim: str | None = None) -> str:
    """Counts of one column of a star's table; without a dimension it is the table's own key."""
    repeated = "0" if dim else "coalesce(sum(n) FILTER (key IS NOT NULL AND n > 1), 0)"
    orphans = f"coalesce(sum(n) FILTER (key IS NOT NULL AND key NOT IN ({dim})), 0)" if dim else "0"
    return f"""
      SELECT '{table}' AS table_name, '{column}' AS column_name,
        CAST(coalesce(sum(n) FILTER (key IS NOT NULL), 0) AS BIGINT) AS known,
        CAST(coalesce(sum(n) FILTER (key IS NULL), 0) AS BIGINT) AS missing,
        CAST({repeated} AS BIGINT) AS repeated, CAST({orphans} AS BIGINT) AS orphans
      FROM (SELECT key, count(*) AS n FROM ({source}) s GROUP BY key) k"""


_FACT = "SELECT {} AS key FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey"
_BRAND = "CAST(split_part(p_brand, '#', 2) AS INTEGER)"
AUDIT = "\nUNION ALL".join(
    (
        _audited("fact_sales", "sale_id", _FACT.format("l_orderkey * 10 + l_linenumber")),
        _audited("fact_sales", "customer_id", _FACT.format("o_custkey"), "SELECT c_custkey FROM customer"),
        _audited("fact_sales", "staff_id", _FACT.format("l_suppkey"), "SELECT s_suppkey FROM supplier"),
        _audited("fact_sales", "product_id", _FACT.format("l_partkey"), "SELECT p_partkey FROM part"),
        _audited("fact_sales", "store_id", _FACT.format("s_nationkey"), "SELECT n_nationkey FROM nation"),
        _audited("dim_customers", "customer_id", "SELECT c_custkey AS key FROM customer"),
        _audited("dim_staffs", "staff_id", "SELECT s_suppkey AS key FROM supplier"),
        _audited("dim_staffs", "store_id", "SELECT s_nationkey AS key FROM supplier", "SELECT n_nationkey FROM nation"),
        _audited("dim_products", "product_id", "SELECT p_partkey AS key FROM part"),
        _audited("dim_products", "brand_id", f"SELECT {_BRAND} AS key FROM part", f"SELECT {_BRAND} FROM part"),
        _audited("dim_products", "category_id", f"SELECT {CATEGORY_KEY} AS key FROM part", f"SELECT {CATEGORY_KEY} FROM part"),
        _audited("dim_brands", "brand_id", f"SELECT DISTINCT {_BRAND} AS key, p_brand FROM part"),
        _audited("dim_categories", "category_id", f"SELECT DISTINCT {CATEGORY_KEY} AS key, p_type FROM part"),
        _audited("dim_stores", "store_id", "SELECT n_nationkey AS key FROM nation"),
    )
)

PREVIEW = _sales(
    "\nUNION ALL\n".join(
        [
            _first_rows(
                "dim_customers",
                ["c_custkey", "c_name", "n_name || ' ' || c_mktsegment", "n_name"],
                "customer LEFT JOIN nation ON c_nationkey = n_nationkey",
            ),
            _first_rows(
                "dim_date",
                ["d", "year(d)", "quarter(d)", "month(d)", "monthname(d)"],
                "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) x",
            ),
            _first_rows(
                "dim_staffs", ["s_suppkey", "s_name", "s_nationkey"], "supplier"
            ),
            _first_rows(
                "dim_products",
                [
                    "p_partkey",
                    "p_name",
                    "CAST(split_part(p_brand, '#', 2) AS INTEGER)",
                    CATEGORY_KEY,
                    "p_retailprice",
                ],
                "part",
            ),
            _first_rows(
                "dim_brands",
                ["CAST(split_part(p_brand, '#', 2) AS INTEGER)", "p_brand"],
                "(SELECT DISTINCT p_brand FROM part) x",
            ),
            _first_rows(
                "dim_categories", [CATEGORY_KEY, "p_type"], "(SELECT DISTINCT p_type FROM part) x"
            ),
            _first_rows("dim_stores", ["n_nationkey", "n_name"], "nation"),
            _first_rows(
                "fact_sales",
                [
                    "sale_id",
                    "order_id",
                    "customer_id",
                    "product_id",
                    "s_nationkey",
                    "staff_id",
                    "order_date",
                    "shipped_date",
                    "quantity",
                    "CAST(list_price AS DOUBLE)",
                    "CAST(discount AS DOUBLE)",
                    "CAST(gross_amount AS DOUBLE)",
                    "CAST(gross_amount AS DOUBLE) * (1 - CAST(discount AS DOUBLE))",
                ],
                "sales LEFT JOIN supplier ON staff_id = s_suppkey",
            ),
        ]
    )
)

ORACLE: dict[str, str] = {
    "net_sales_rows": _sales(
        f"""SELECT sale_id, product_id, quantity, {_dbl('list_price')} AS list_price,
               {_dbl('discount')} AS discount, {_dbl('net_sales')} AS net_sales FROM sales"""
    ),
    "period_columns": _sales(
        f"""SELECT sale_id, {PERIOD['year']} AS year, {PERIOD['quarter']} AS quarter,
               {PERIOD['month']} AS month, CAST(order_date AS VARCHAR) AS date FROM sales"""
    ),
    "ship_lag_rows": _sales(
        """SELECT sale_id, CAST(lag_days AS INTEGER) AS order_to_ship_days,
               coalesce(lag_days <= 0, false) AS on_time FROM sales"""
    ),
    "cube_measures_b": _cube(f"SELECT sale_id, {_amounts('order_value_b')} FROM cube"),
    "cube_measures_a": _cube(f"SELECT sale_id, {_amounts('order_value_a')} FROM cube"),
    "time_hierarchy": _cube(
        "SELECT sale_id, year_date, quarter_date, month_date, year_month, year_quarter FROM cube"
    ),
    "star_enriched": _sales(
        f"""SELECT sale_id, order_id, customer_id, product_id,
               CAST(order_date AS VARCHAR) AS order_date, quantity,
               {_dbl('net_sales')} AS net_sales, product_name, category_name, brand_name,
               store_name, customer_city, customer_state FROM sales"""
    ),
    "snowflake_products": """
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_name,
               p_brand AS brand_name FROM part""",
    "cube_b": _cube(
        f"""SELECT sale_id, CAST(order_date AS VARCHAR) AS order_date_key, customer_id AS customer_key,
               staff_id AS employee_key, product_id AS product_key, quantity, month_name_date,
               year_date, quarter_date, month_date, year_month, year_quarter,
               customer_fullname AS company_name_customer, customer_city AS city_customer,
               customer_region AS country_region_customer, staff_fullname AS full_name_employee,
               store_name AS city_employee, product_name AS product_name_product,
               category_name AS category_product, {_amounts('order_value_b')} FROM cube"""
    ),
    "cube_a": _cube(
        f"""SELECT sale_id, customer_id, staff_id, product_id, quantity, month_name_date,
               year_date, quarter_date, month_date, year_month, year_quarter,
               customer_fullname AS customer_fullname_customer,
               customer_city AS customer_city_customer, staff_fullname AS staff_fullname_staff,
               product_name AS product_name_product, brand_name AS brand_name_brand,
               category_name AS category_name_category, store_name AS store_name_store,
               {_amounts('order_value_a')} FROM cube"""
    ),
    "sales_in_range": _sales(
        f"""SELECT sale_id, order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date,
               {_dbl('net_sales')} AS net_sales
        FROM sales WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'"""
    ),
    "sales_by_lists": _sales(
        f"""SELECT sale_id, store_name, brand_name, category_name, quantity,
               {_dbl('net_sales')} AS net_sales
        FROM sales WHERE store_name IN ('NATION_1', 'NATION_7', 'NATION_12')
          AND brand_name IN ('Brand#2', 'Brand#17', 'Brand#4')
          AND category_name IN ('ECONOMY', 'SMALL')"""
    ),
    "cube_slice": _cube(
        f"""SELECT sale_id, year_date, quarter_date, month_date, year_month, year_quarter,
               customer_city AS city_customer, category_name AS category_product,
               {_dbl('revenue')} AS revenue, {_dbl('profit')} AS profit FROM cube {SLICE}"""
    ),
    "cube_slice_kpi": _kpi("order_value_b", SLICE),
    "filter_options": RANKED.format("""
        SELECT DISTINCT 'store' AS field, n_name AS value FROM nation WHERE n_name IS NOT NULL
        UNION ALL SELECT DISTINCT 'brand', p_brand FROM part WHERE p_brand IS NOT NULL
        UNION ALL SELECT DISTINCT 'category', p_type FROM part WHERE p_type IS NOT NULL"""),
    "cube_filter_options": _cube(RANKED.format(
        "\nUNION ALL ".join(
            f"SELECT DISTINCT '{field}' AS field, CAST({column} AS VARCHAR) AS value "
            f"FROM cube WHERE {column} IS NOT NULL"
            for field, column in (
                ("year", "year_date"),
                ("quarter", "quarter_date"),
                ("month", "month_date"),
                ("city", "customer_city"),
                ("category", "category_name"),
            )
        ))
    ),
    "table_preview": PREVIEW,
    "sales_kpi": _sales(
        f"""SELECT {_dbl('coalesce(sum(net_sales), 0)')} AS total_sales,
               count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers,
               round(coalesce({_dbl('sum(net_sales)')}
                 / nullif(count(DISTINCT order_id), 0), 0), 6) AS aov
        FROM sales"""
    ),
    "kpi_display": _sales(
        f"""SELECT '$' || format('{{:,}}', CAST(round_even({_dbl('total')}, 0) AS BIGINT))
                 AS total_sales,
               format('{{:,}}', orders) AS orders, format('{{:,}}', customers) AS customers,
               '$' || format('{{:,}}', CAST(round_even({_dbl('total')} / orders, 0) AS BIGINT))
                 AS aov,
               strftime(first_day, '%d %b %Y') || ' – ' || strftime(last_day, '%d %b %Y')
                 AS caption
        FROM (SELECT sum(net_sales) AS total, count(DISTINCT order_id) AS orders,
                     count(DISTINCT customer_id) AS customers, min(order_date) AS first_day,
                     max(order_date) AS last_day FROM sales) t"""
    ),
    "trend_month": _trend_sql("month"),
    "trend_quarter": _trend_sql("quarter"),
    "trend_year": _trend_sql("year"),
    "period_growth": _growth_sql("month"),
    "period_growth_quarter": _growth_sql("quarter"),
    "period_growth_year": _growth_sql("year"),
    "top_products_revenue": _top("net_sales", "product_name"),
    "top_products_qty": _top("quantity", "product_name"),
    "top_products_revenue_by_id": _top("net_sales", "product_id, product_name"),
    "top_products_qty_by_id": _top("quantity", "product_id, product_name"),
    "brand_category_sales": _sales(
        f"""SELECT brand_name, category_name, {_dbl('coalesce(sum(net_sales), 0)')} AS net_sales
        FROM sales WHERE brand_name IS NOT NULL AND category_name IS NOT NULL GROUP BY 1, 2"""
    ),
    "brand_category_rollup": _sales(
        f"""SELECT brand_name, category_name,
               CAST(grouping(brand_name, category_name) AS INTEGER) AS level,
               {_dbl('coalesce(sum(net_sales), 0)')} AS net_sales
        FROM sales WHERE brand_name IS NOT NULL AND category_name IS NOT NULL
        GROUP BY ROLLUP (brand_name, category_name)"""
    ),
    "discount_effect_left": _bins(
        ["0", "0.05", "0.10", "0.15", "0.20", "0.25", "1.0"],
        ["0-5%", "5-10%", "10-15%", "15-20%", "20-25%", "25%+"],
        ">=",
        "<",
    ),
    "discount_effect_right": _bins(
        ["-0.01", "0.05", "0.10", "0.15", "0.20"],
        ["0-5%", "5-10%", "10-15%", "15-20%"],
        ">",
        "<=",
    ),
    "date_bounds": _sales(
        "SELECT CAST(min(order_date) AS VARCHAR) AS min_date, "
        "CAST(max(order_date) AS VARCHAR) AS max_date FROM sales"
    ),
    "repeat_kpi_rows": _sales(
        """SELECT count(*) AS total_customers,
               count(*) FILTER (WHERE n > 1) AS repeat_customers,
               round(coalesce(CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE)
                 / nullif(count(*), 0), 0), 6) AS repeat_rate
        FROM (SELECT customer_id, count(*) AS n FROM sales
              WHERE customer_id IS NOT NULL GROUP BY 1) c"""
    ),
    "repeat_by_state_rows": _sales(_by_rows("customer_state")),
    "repeat_by_city_rows": _sales(
        f"""SELECT customer_city, customers, orders, repeat_rate
        FROM ({_by_rows('customer_city')}) t"""
    ),
    "repeat_by_state_orders": _sales(
        _by_orders("customer_state") + " ORDER BY repeat_rate DESC, customer_state"
    ),
    "repeat_by_city_orders": _sales(
        _by_orders("customer_city") + " ORDER BY repeat_rate DESC, customer_city"
    ),
    "customers_by_state": _sales(
        """SELECT customer_state, count(DISTINCT customer_id) AS customers
        FROM sales WHERE customer_state IS NOT NULL GROUP BY 1"""
    ),
    "customers_by_state_dim": """
        SELECT n_name AS customer_state, count(DISTINCT c_custkey) AS customers
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        WHERE n_name IS NOT NULL GROUP BY 1""",
    "top_states_customers": _sales(
        _by_rows("customer_state") + " ORDER BY customers DESC, customer_state LIMIT 15"
    ),
    "top_states_repeat": _sales(
        f"""SELECT * FROM ({_by_rows('customer_state')}) t WHERE customers >= 2
        ORDER BY repeat_rate DESC, customer_state LIMIT 15"""
    ),
    "customer_threshold": _sales(
        f"SELECT max_cust, least(10, max_cust) AS min_c FROM ({LARGEST}) t"
    ),
    "top_cities_repeat": _sales(
        f"""SELECT * FROM ({_by_orders('customer_city')}) t
        WHERE customers >= (SELECT least(10, max_cust) FROM ({LARGEST}) u)
        ORDER BY repeat_rate DESC, customer_city LIMIT 15"""
    ),
    "top_states_repeat_orders": _sales(
        f"""SELECT * FROM ({_by_orders('customer_state')}) t
        WHERE customers >= (SELECT least(10, max_cust) FROM ({LARGEST}) u)
        ORDER BY repeat_rate DESC, customer_state LIMIT 15"""
    ),
    "repeat_display": _sales(
        f"""SELECT customer_state, format('{{:,}}', repeat_customers) AS repeat_customers,
               format('{{:,}}', non_repeat_customers) AS non_repeat_customers,
               format('{{:.1f}}%', CAST(repeat_customers AS DOUBLE) / customers * 100)
                 AS repeat_rate
        FROM ({_by_rows('customer_state')}) t"""
    ),
    "store_performance": _sales(_performance("store_name")),
    "store_performance_orders": _sales(_performance("store_name")),
    "store_sales_share": _sales(
        f"""SELECT store_name, net_sales, round(net_sales / sum(net_sales) OVER (), 6) AS share
        FROM ({_performance('store_name')}) t"""
    ),
    "store_orders_share": _sales(
        f"""SELECT store_name, orders,
               round(CAST(orders AS DOUBLE) / CAST(sum(orders) OVER () AS DOUBLE), 6) AS share
        FROM ({_performance('store_name')}) t"""
    ),
    "staff_kpi": _sales(
        """SELECT (SELECT count(DISTINCT s_suppkey) FROM supplier) AS total_staffs,
               round(coalesce(CAST(sum(s) AS DOUBLE) / nullif(count(s), 0), 0), 6)
                 AS avg_sales_per_staff
        FROM (SELECT staff_id, coalesce(sum(net_sales), 0) AS s FROM sales
              WHERE staff_id IS NOT NULL GROUP BY 1) t"""
    ),
    "best_staff": _sales(
        f"""SELECT staff_fullname AS best_staff, net_sales AS best_staff_sales
        FROM ({_performance('staff_fullname')}) t ORDER BY net_sales DESC, 1 LIMIT 1"""
    ),
    "top_staff_sales": _sales(
        _performance("staff_fullname") + " ORDER BY net_sales DESC, staff_fullname LIMIT 10"
    ),
    "top_staff_orders": _sales(
        _performance("staff_fullname") + " ORDER BY orders DESC, staff_fullname LIMIT 10"
    ),
    "staff_sales_share": _sales(
        f"""SELECT staff_fullname, net_sales,
               round(net_sales / sum(net_sales) OVER (), 6) AS share
        FROM (SELECT * FROM ({_performance('staff_fullname')}) p
              ORDER BY net_sales DESC, staff_fullname LIMIT 10) t"""
    ),
    "ship_performance": _sales(SHIPPING),
    "ship_trend": _sales(
        f"""SELECT round(regr_slope(on_time_rate, avg_days), 6) AS slope,
               round(regr_intercept(on_time_rate, avg_days), 6) AS intercept,
               round(regr_r2(on_time_rate, avg_days), 6) AS r2
        FROM ({SHIPPING}) t"""
    ),
    "cube_kpi": _kpi("order_value_b"),
    "cube_top_products": _revenue_by("product_name", "product_name_product", TOP_REVENUE),
    "cube_top_cities": _revenue_by("customer_city", "city_customer", TOP_REVENUE),
    "cube_category_sales": _revenue_by("category_name", "category_product"),
    "cube_month_financial": MONTH_FINANCIAL,
    "cube_summary": _summary("category_product", "city_customer"),
    "cube_a_kpi": _kpi("order_value_a"),
    "cube_a_top_products": _revenue_by("product_name", "product_name_product", TOP_REVENUE),
    "cube_a_top_cities": _revenue_by("customer_city", "customer_city_customer", TOP_REVENUE),
    "cube_a_category_sales": _revenue_by("category_name", "category_name_category"),
    "cube_a_month_financial": MONTH_FINANCIAL,
    "cube_a_summary": _summary("category_name_category", "customer_city_customer"),
}

# The same results by the public operators over a loaded star. The pages drop undated sales.
DATED = "FROM sales WHERE order_date IS NOT NULL"
ORACLE |= {
    "star_of_tables": ORACLE["star_enriched"],
    "cube_a_of_tables": ORACLE["cube_a"],
    "cube_b_of_tables": ORACLE["cube_b"],
    "star_audit": AUDIT,
    "exported_summary": ORACLE["cube_summary"],
    "lattice_slice_kpi": ORACLE["cube_slice_kpi"],
    "lattice_top_products": ORACLE["cube_top_products"],
    "lattice_month_financial": ORACLE["cube_month_financial"],
    "lattice_summary": ORACLE["cube_summary"],
    "page_kpi": ORACLE["sales_kpi"].replace("FROM sales", DATED),
    "kept_trend_month": ORACLE["trend_month"],
    "kept_repeat_kpi": ORACLE["repeat_kpi_rows"].replace("FROM sales\n              WHERE", DATED + " AND"),
    "kept_repeat_by_state": ORACLE["repeat_by_state_rows"].replace("FROM sales\n            WHERE", DATED + " AND"),
    "kept_repeat_by_city_orders": ORACLE["repeat_by_city_orders"].replace("FROM sales\n            WHERE", DATED + " AND"),
    "page_brand_category": ORACLE["brand_category_sales"].replace("FROM sales WHERE", DATED + " AND"),
    "page_repeat_by_state": ORACLE["repeat_by_state_rows"].replace("FROM sales\n            WHERE", DATED + " AND"),
}
