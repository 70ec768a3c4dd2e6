"""Checks of a loaded star, its export, and what bitmaps of keys keep."""

import pytest
from pyspark.sql import functions as F

from saleslens.functions import bitmaps
from saleslens.operators import cube, options, quality
from saleslens.sources import store
from saleslens.sources.schemas import SUMMARY
from saleslens.sources.sinks import read_csv, write_csv
from shop import random_shop_rows, shop, values


def test_audit_of_a_star_with_faults(spark):
    rows = random_shop_rows(3)
    rows["dim_brands"] += [{"brand_id": 1, "brand_name": "again"}, {"brand_id": None, "brand_name": "none"}]
    found = {(r.table_name, r.column_name): r for r in quality.audit(shop(spark, rows)).collect()}
    assert len(found) == len(quality.KEYS) + len(quality.REFERENCES)
    for table, key in quality.KEYS.items():
        keys = [row.get(key) for row in rows[table]]
        r = found[table, key]
        assert (r.known, r.missing) == (sum(k is not None for k in keys), keys.count(None))
        assert r.repeated == sum(k is not None and keys.count(k) > 1 for k in keys) and r.orphans == 0
    for table, column, dim in quality.REFERENCES:
        known = {row.get(quality.KEYS[dim]) for row in rows[dim]}
        keys = [row.get(column) for row in rows[table]]
        r = found[table, column]
        assert r.missing == keys.count(None) and r.repeated == 0
        assert r.orphans == sum(k is not None and k not in known for k in keys)
    assert found["dim_brands", "brand_id"].repeated == 2 and found["dim_brands", "brand_id"].missing == 1
    assert found["fact_sales", "product_id"].orphans > 0


def test_audit_of_empty_tables(spark):
    assert values(quality.audit(shop(spark, {}))) == []


def test_an_export_reads_back_as_it_was(spark, tmp_path):
    tables = shop(spark, random_shop_rows(4))
    summary = cube.cube_summary(cube.shop_cube(tables["fact_sales"], tables), "category_name_category", "customer_city_customer")
    summary = summary.toDF(*SUMMARY)
    path = write_csv(summary, f"file://{tmp_path}", "summary")
    assert sorted(values(read_csv(spark, path, SUMMARY))) == sorted(values(summary)) != []
    with pytest.raises(ValueError, match="written to its end"):
        read_csv(spark, f"file://{tmp_path}/none", SUMMARY)
    wrong = {name: "bigint" for name in SUMMARY}
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, path, wrong).collect()


def test_rows_among_noted_keys(spark):
    keys = [None, -1, 0, 63, 64, 2**62]
    sold = spark.createDataFrame([(k, j) for k in keys for j in (1, 70)], "k bigint, j int")
    words = bitmaps.noted(sold, "k", "j")
    listed = spark.range(-70, 140).union(spark.createDataFrame([(2**62,), (None,)], "id bigint"))
    assert {r.id for r in bitmaps.among(listed, "id", words, 0).collect()} == {-1, 0, 63, 64, 2**62}
    assert {r.id for r in bitmaps.among(listed, "id", words, 1).collect()} == {1, 70}


def test_heads_with_ties_and_missing_keys(spark):
    df = spark.createDataFrame([(None, "z"), (2, "a"), (2, "b"), (1, "c"), (3, "d"), (2, "e")], "k int, v string")
    assert {r.v for r in options.heads(df, "k", 3).collect()} == {"z", "c", "a", "b", "e"}
    assert options.heads(df.filter(F.lit(False)), "k").collect() == []


def test_buckets_hold_their_keys(spark):
    copy = store.bucketed(spark.range(50).withColumn("x", F.col("id") * 2), "id", 4)
    assert sorted(values(copy)) == [(k, 2 * k) for k in range(50)]
