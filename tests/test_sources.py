"""Loading stars from Parquet, and writing reports."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saleslens.functions.measures import with_net_sales
from saleslens.plans import pages
from saleslens.plans.catalog import CATALOG
from saleslens.sources.parquet import conform, load_shop, load_warehouse, open_table
from saleslens.sources.schemas import SHOP_TABLES, WAREHOUSE_TABLES
from saleslens.sources.sinks import shared, write_csv
from shop import random_shop_rows, shop, values, warehouse


def test_a_star_round_trips_through_parquet(spark, tmp_path):
    written = shop(spark, random_shop_rows(3, sales=50))
    for name, df in written.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    loaded = load_shop(spark, str(tmp_path))
    assert set(loaded) == set(SHOP_TABLES)
    for name, df in loaded.items():
        assert df.schema.simpleString() == written[name].schema.simpleString()
        assert df.count() == written[name].count()
    kpi = pages.sales_page(pages.sales_frame(loaded))["kpi"]
    assert values(kpi) == values(pages.sales_page(pages.sales_frame(written))["kpi"])


def test_the_warehouse_star_loads(spark, tmp_path):
    for name, df in warehouse(spark, {}).items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    loaded = load_warehouse(spark, str(tmp_path))
    assert set(loaded) == set(WAREHOUSE_TABLES)
    assert loaded["fact_sales"].count() == 0


def test_a_missing_column_is_refused_and_types_are_cast(spark):
    df = spark.createDataFrame([(1, 1.5)], "brand_id bigint, brand_name double")
    got = conform(df, SHOP_TABLES["dim_brands"], "dim_brands")
    assert got.schema.simpleString() == "struct<brand_id:int,brand_name:string>"
    with pytest.raises(ValueError, match="dim_brands lacks columns: brand_name"):
        conform(df.drop("brand_name"), SHOP_TABLES["dim_brands"], "dim_brands")


def test_values_that_a_type_cannot_hold_are_refused(spark):
    columns = {"brand_id": "int", "price": "double"}
    good = spark.createDataFrame([(2.0, Decimal("10.005")), (None, None)], "brand_id double, price decimal(10,3)")
    assert values(conform(good, columns, "t")) == [(2, 10.005), (None, None)]
    bad = spark.createDataFrame([(2.5, Decimal("10.005"))], "brand_id double, price decimal(10,3)")
    with pytest.raises(Exception, match="t.brand_id can't be held as int: 2.5"):
        conform(bad, columns, "t").collect()


def test_fractions_of_units_prices_and_discounts_are_kept(spark):
    assert {SHOP_TABLES["fact_sales"][c] for c in ("quantity", "list_price", "discount")} == {"double"}
    kinds = "quantity double, list_price double, discount double"
    row = spark.createDataFrame([(2.5, 10.005, 0.125)], kinds)
    (net,) = values(with_net_sales(row).select("net_sales"))
    assert net == (Decimal(21885938),)  # 21.8859375, half to even in millionths


def test_appended_files_are_read(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    assert open_table(spark, path).count() == 3
    spark.range(7).write.mode("append").parquet(path)
    assert open_table(spark, path).count() == 10


def test_a_registered_query_reads_appended_files(spark, tmp_path):
    for name in ("nation", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = CATALOG["filter_options"](spark, str(tmp_path)).count()
    nations = spark.read.parquet(f"{tmp_path}/nation.parquet").limit(1)
    nations.withColumn("n_name", F.lit("NEW")).write.mode("append").parquet(f"{tmp_path}/nation.parquet")
    assert CATALOG["filter_options"](spark, str(tmp_path)).count() == before + 1


def test_csv_has_a_header_and_every_row(spark, tmp_path):
    rows = [("a", Decimal("1.50")), ("b", None)]
    report = spark.createDataFrame(rows, "k string, v decimal(4,2)")
    path = write_csv(report, str(tmp_path), "sales_summary", files=1)
    assert path.startswith(f"{tmp_path}/sales_summary_2")
    back = spark.read.option("header", True).csv(path)
    assert sorted(values(back), key=str) == [("a", "1.50"), ("b", None)]
    assert len(list(tmp_path.glob("sales_summary_*/part-*"))) == 1


def test_csv_files_follow_the_partitions(spark, tmp_path):
    path = write_csv(spark.range(0, 40, 1, 4).withColumn("v", F.col("id") * 2), str(tmp_path), "x")
    assert spark.read.option("header", True).csv(path).count() == 40
    assert len(list(tmp_path.glob("x_*/part-*"))) == 4


def test_a_shared_frame_is_released(spark):
    frame = spark.range(10)
    with shared(frame) as kept:
        assert kept.is_cached
        assert kept.count() == 10
    assert not frame.is_cached
