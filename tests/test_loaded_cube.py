"""The cube of a loaded star on rows of its own: nulls, orphans and repeated keys."""

from datetime import datetime

from saleslens.operators import cube
from saleslens.plans.catalog import CATALOG
from saleslens.sources.retail import retail, with_charges

DAY = datetime(2020, 2, 29)

ROWS = {
    "region": ("r_regionkey int, r_name string", [(1, "EAST"), (None, "NOWHERE")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "A", 1), (2, "B", None), (2, "C", 1)]),
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        [(1, "Ann", 1, 0.0, "X"), (2, "Bob", 2, 0.0, None), (None, "Nil", 1, 0.0, "X")],
    ),
    "supplier": (
        "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
        [(1, "S1", 1, 0.0), (1, "S1 again", 9, 0.0), (2, None, 2, 0.0), (None, "S0", 1, 0.0)],
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        [(1, "tea", "Brand#1", "DRINK", 1, 1.25), (2, "jam", "Brand#2", None, 1, None)],
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
        [(1, 1, DAY), (2, 2, None), (3, None, DAY), (None, 1, DAY)],
    ),
    "lineitem": (
        "l_linenumber int, l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
        "l_discount double, l_shipdate timestamp_ntz, l_extendedprice double, l_tax double",
        [
            (1, 1, 1, 1, 2.0, 0.1, DAY, 10.0, 0.05),
            (2, 1, 2, 2, 1.0, None, DAY, 10.0, 0.05),
            (1, 2, 1, 2, 1.0, 0.1, None, 3.0, None),
            (1, 3, None, None, None, 0.0, DAY, None, 0.05),
            (1, 9, 9, 9, 1.0, 0.0, DAY, 0.0, 0.0),
            (None, None, 1, 1, 1.0, 0.0, DAY, 5.5, 0.5),
        ],
    ),
}


def star(spark, folder):
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows(df, *names):
    return sorted((tuple(row) for row in df.select(*names).collect()), key=repr)


def test_the_cube_of_tables_with_nulls_orphans_and_repeated_keys(spark, tmp_path):
    found = CATALOG["cube_b_of_tables"](spark, star(spark, tmp_path))
    shown = rows(found, "sale_id", "full_name_employee", "city_employee", "city_customer", "revenue", "order_value")
    assert shown == sorted(
        [
            (11, "S1", "A", "A X", 9.0, 9.45),
            (11, "S1 again", None, "A X", 9.0, 9.45),
            (12, None, "B", "A X", None, None),
            (12, None, "C", "A X", None, None),
            *((21, None, city, None, 2.7, 2.7) for city in "BBCC"),  # the customer's nation is twice there too
            (31, None, None, None, None, None),
            (91, None, None, None, 0.0, 0.0),
            (None, "S1", "A", None, 5.5, 8.25),
            (None, "S1 again", None, None, 5.5, 8.25),
        ],
        key=repr,
    )


def test_charges_made_anew_are_those_of_the_fact(spark, tmp_path):
    tables = retail(spark, star(spark, tmp_path)).warehouse()
    early = cube.warehouse_cube(tables["fact_sales"], tables)
    late = cube.warehouse_cube(tables["fact_sales"], tables, with_charges)
    assert early.columns == late.columns
    assert rows(early, *early.columns) == rows(late, *early.columns)
