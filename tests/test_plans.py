"""What the physical plans must and must not contain, with the joins of a cluster-sized star.

Broadcasting by size is turned off here, so the plans are those of dimensions too large for it.
"""

import re

import pytest

from saleslens.operators.filters import SalesFilter
from saleslens.plans import pages
from saleslens.plans.catalog import CATALOG
from shop import random_shop_rows, shop

SF_DIR = "/root/testdata/sf0.001"

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.maxMetadataStringLength": "2000",
}

# Queries that list or judge single sales; only these may move fact rows to a dimension's key
# without combining them first.
ROW_LEVEL = {
    "net_sales_rows",
    "period_columns",
    "ship_lag_rows",
    "cube_measures_a",
    "cube_measures_b",
    "time_hierarchy",
    "star_enriched",
    "snowflake_products",
    "cube_a",
    "cube_b",
    "sales_in_range",
    "sales_by_lists",
    "cube_slice",
    "star_of_tables",
    "cube_a_of_tables",
    "cube_b_of_tables",
    "exported_summary",  # reads a written report
}
# Growth reads a written trend of two periods; test_growth.py checks the plan that writes it.
WRITTEN = {"period_growth", "period_growth_quarter"}

# Queries that count distinct keys beside sums.
COUNTED = [
    "cube_a_kpi",
    "cube_a_summary",
    "cube_kpi",
    "cube_slice_kpi",
    "cube_summary",
    "page_kpi",
    "store_performance",
    "store_performance_orders",
    "top_staff_orders",
    "top_staff_sales",
]
# Queries that read a result twice; the second reading reuses the exchange of the first.
REUSED = {
    "store_orders_share",
    "store_sales_share",
    "top_cities_repeat",
    "top_states_repeat_orders",
}

TOP_LISTS = [
    "best_staff",
    "cube_a_top_cities",
    "cube_a_top_products",
    "cube_top_cities",
    "cube_top_products",
    "table_preview",
    "top_cities_repeat",
    "top_products_qty",
    "top_products_qty_by_id",
    "top_products_revenue",
    "top_products_revenue_by_id",
    "top_staff_orders",
    "top_staff_sales",
    "top_states_customers",
    "top_states_repeat",
    "top_states_repeat_orders",
]


@pytest.fixture(scope="module")
def plans(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    made = {}
    for name, build in CATALOG.items():
        execution = build(spark, SF_DIR)._jdf.queryExecution()
        made[name] = execution.executedPlan().toString()
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return made


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_no_python_and_no_pairing_of_all_rows(plans, name):
    plan = plans[name]
    assert not re.search(r"Python|Pandas|Arrow", plan)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_only_the_calendar_is_broadcast_regardless_of_size(plans, name):
    for line in plans[name].splitlines():
        if "BroadcastHashJoin" in line:
            assert "date_key_date" in line


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_windows_run_on_limited_rows_only(plans, name):
    if name in ("filter_options", "cube_filter_options"):  # ranks the distinct values of each field
        lines = [line for line in plans[name].splitlines() if re.search(r"\bWindow\b", line)]
        assert len(lines) == 1 and "[field" in lines[0]
    elif re.search(r"\bWindow\b", plans[name]):
        assert name == "staff_sales_share"
        assert "TakeOrderedAndProject(limit=10" in plans[name]


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_only_grouped_rows_meet_in_one_task(plans, name):
    lines = plans[name].splitlines()
    for at, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert re.search(r"HashAggregate|LocalLimit|TakeOrdered", lines[at + 1]), lines[at + 1]


def test_the_preview_sorts_keys_alone(plans):
    columns = scan_columns(plans["table_preview"], "lineitem")
    assert {"l_orderkey", "l_linenumber"} in columns and len(columns) == 2


@pytest.mark.parametrize("name", TOP_LISTS)
def test_top_lists_keep_only_their_head(plans, name):
    assert "TakeOrderedAndProject" in plans[name]


@pytest.mark.parametrize("name", sorted(set(CATALOG) - ROW_LEVEL - WRITTEN))
def test_reports_are_grouped(plans, name):
    assert "HashAggregate" in plans[name]
    assert not re.search(r"SortAggregate\(key=\[\w", plans[name])


def scan_columns(plan, table):
    found = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*?/%s\.parquet" % table, plan)
    return [{re.sub(r"#\d+L?", "", column) for column in columns.split(",")} for columns in found]


def test_scans_read_only_what_a_report_uses(spark):
    def scanned(name, table):
        execution = CATALOG[name](spark, SF_DIR)._jdf.queryExecution()
        return scan_columns(execution.executedPlan().toString(), table)

    assert scanned("trend_month", "lineitem") == [
        {"l_orderkey", "l_partkey", "l_quantity", "l_discount"}
    ]
    assert scanned("trend_month", "orders") == [{"o_orderkey", "o_orderdate"}]
    assert scanned("repeat_kpi_rows", "lineitem") == [{"l_orderkey"}]
    assert scanned("top_products_qty", "lineitem") == [{"l_partkey", "l_quantity"}]
    assert scanned("cube_top_cities", "lineitem") == [
        {"l_orderkey", "l_extendedprice", "l_discount"}
    ]


def test_the_date_range_reaches_the_scan(plans):
    scan = next(
        line for line in plans["sales_in_range"].splitlines() if "orders.parquet" in line
    )
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in scan
    assert "LessThan(o_orderdate,1998-04-01" in scan


def test_lists_filter_the_dimension_before_the_join(plans):
    plan = plans["sales_by_lists"]
    part = next(line for line in plan.splitlines() if "part.parquet" in line)
    assert "In(p_brand" in part and "In(p_type" in part
    assert "LeftOuter" not in plan


def test_orders_of_a_period_need_no_shuffle_of_their_own(plans):
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plans["trend_month"])
    keys = sorted(re.sub(r"#\d+L?|, \d+$", "", key) for key in exchanges)
    assert keys == ["month", "order_id", "order_id", "product_id", "product_id"]


def test_product_reports_shuffle_the_fact_once_and_combined(plans):
    plan = plans["top_products_revenue"]
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    keys = sorted(re.sub(r"#\d+L?|, \d+$", "", key) for key in exchanges)
    assert keys == ["product_id", "product_id", "product_name"]


def test_a_share_reads_its_groups_once(spark):
    df = CATALOG["store_sales_share"](spark, SF_DIR)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    assert final.count("lineitem.parquet") <= 1


@pytest.mark.parametrize("name", sorted(set(CATALOG) - REUSED))
def test_the_fact_is_scanned_once_unless_listed(plans, name):
    # the preview finds its least keys in a scan of their column alone
    assert plans[name].count("lineitem.parquet") <= (2 if name == "table_preview" else 1)


def exchange_keys(plan):
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    return [re.sub(r"#\d+L?|, \d+$", "", key) for key in exchanges]


@pytest.mark.parametrize("name", COUNTED)
def test_distinct_keys_are_counted_by_bitmaps(plans, name):
    """One scan, no copies of rows, and no shuffle by the key but that of a join."""
    assert plans[name].count("lineitem.parquet") == 1
    assert "Expand" not in plans[name]
    keys = exchange_keys(plans[name])
    assert not any("sale_id" in key for key in keys)
    assert keys.count("order_id") in (0, 2)  # the two sides of the join with the orders
    assert sum("key_word" in key for key in keys) == 1


@pytest.mark.parametrize("name, joins", [("cube_slice", 5), ("cube_slice_kpi", 3)])
def test_slices_join_what_they_read_and_prune_orders(plans, name, joins):
    plan = plans[name]
    assert len(re.findall(r"SortMergeJoin|HashJoin", plan)) == joins
    scans = [line for line in plan.splitlines() if "orders.parquet" in line]
    assert any(
        "GreaterThanOrEqual(o_orderdate,1998-01-01" in scan
        and "LessThan(o_orderdate,1998-04-01" in scan
        for scan in scans
    )


@pytest.mark.parametrize("name", ["discount_effect_left", "discount_effect_right"])
def test_discounts_reach_the_price_summed(plans, name):
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plans[name])
    keys = [re.sub(r"#\d+L?|, \d+$", "", key) for key in exchanges]
    assert "product_id, bin" in keys and keys.count("product_id") == 2


@pytest.mark.parametrize("name", ["sales_kpi", "kpi_display"])
def test_order_kpis_copy_no_rows(plans, name):
    assert "Expand" not in plans[name]


def joined(df):
    return len(re.findall(r"SortMergeJoin|HashJoin", df._jdf.queryExecution().executedPlan().toString()))


def test_page_tables_join_only_what_they_read(spark):
    tables = shop(spark, random_shop_rows(1))
    page = pages.sales_report(tables)
    for name in ("kpi", "trend", "growth", "discount_left", "dates"):
        assert joined(page[name]) == 0, name
    for name in ("top_revenue", "top_quantity_by_id", "brand_category"):
        assert joined(page[name]) == 3, name  # product, brand and category
    chosen = pages.sales_report(tables, SalesFilter(stores=("a",)))
    assert joined(chosen["kpi"]) == 1
    people = pages.customer_report(tables)
    assert joined(people["kpi"]) == 0 and joined(people["repeat_by_state"]) == 1


@pytest.mark.parametrize("name", ["cube_a_of_tables", "cube_b_of_tables"])
def test_a_loaded_cube_moves_no_sale_for_its_calendar(plans, name):
    """The calendar comes last, by broadcast, and the widest dimension just before it."""
    joins = [line for line in plans[name].splitlines() if re.search(r"HashJoin|SortMergeJoin", line)]
    assert "BroadcastHashJoin" in joins[0] and "date_key_date" in joins[0]
    assert not re.search(r"hashpartitioning\((order_date_key|order_day)", plans[name])
    facts = [line for line in joins if re.search(r"\[(customer|product|staff|employee)_(id|key)#", line)]
    assert "customer" in facts[0]


@pytest.mark.parametrize("name", ["star_of_tables", "cube_a_of_tables", "cube_b_of_tables"])
def test_amounts_and_sale_keys_are_made_after_the_joins_of_a_loaded_fact(plans, name):
    lines = plans[name].splitlines()
    made = [at for at, line in enumerate(lines) if "AS sale_id#" in line]
    orders = [at for at, line in enumerate(lines) if "SortMergeJoin [order_id#" in line]
    assert len(made) == 1 and made[0] < orders[0]


def test_a_loaded_cube_moves_rates_and_makes_charges_after_its_joins(plans):
    lines = plans["cube_b_of_tables"].splitlines()
    last = next(at for at, line in enumerate(lines) if "SortMergeJoin [customer_key#" in line)
    assert not any(re.search(r"(net_amount|taxes)#", line) for line in lines[last:])
    assert any("discount#" in line and "tax#" in line for line in lines[last:])


def test_a_loaded_cube_moves_no_sale_for_employees_of_a_size_to_broadcast(spark):
    """Only stored employees have a size by which Spark can tell."""
    plan = CATALOG["cube_b_of_tables"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [employee_key#" in plan
    assert not re.search(r"hashpartitioning\(employee_key", plan)
