"""A third of all sales on one product, order, customer and seller, joined without broadcasts."""

import pytest
from pyspark.sql import functions as F

from saleslens.plans.catalog import CATALOG
from saleslens.plans.oracle import ORACLE
from compare import differences

SOURCE = "/root/testdata/sf0.01"
COPIED = ("region", "nation", "customer", "supplier", "part")

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "48KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    read = lambda name: spark.read.parquet(f"{SOURCE}/{name}.parquet")
    hot = F.pmod(F.col("l_shipdate").cast("timestamp").cast("bigint") / 86400, F.lit(3)) < 1
    lines = read("lineitem")
    for key in ("l_orderkey", "l_partkey", "l_suppkey"):
        lines = lines.withColumn(key, F.when(hot, F.lit(7)).otherwise(F.col(key)).cast("bigint"))
    lines.repartition(8).write.parquet(f"{folder}/lineitem.parquet")
    buys = F.when(F.col("o_orderkey") % 3 == 1, F.lit(5)).otherwise(F.col("o_custkey"))
    orders = read("orders").withColumn("o_custkey", buys.cast("bigint"))
    orders.repartition(4).write.parquet(f"{folder}/orders.parquet")
    for name in COPIED:
        read(name).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield str(folder)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def con(skewed):
    import duckdb

    con = duckdb.connect()
    for name in (*COPIED, "lineitem", "orders"):
        con.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{skewed}/{name}.parquet/*.parquet')"
        )
    return con


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_results_hold_under_skew(spark, skewed, con, name):
    df = CATALOG[name](spark, skewed)
    mine = df.toArrow()
    theirs = con.sql(ORACLE[name]).to_arrow_table()
    assert differences(mine, theirs) == []


def executed_plan(df):
    """Plan text after a run; only a plan as executed can carry a skew mark."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "net_sales_rows",
        "star_enriched",
        "sales_kpi",
        "store_performance",
        "ship_performance",
        "cube_kpi",
        "cube_summary",
    ],
)
def test_joins_of_fact_rows_split_the_hot_key(spark, skewed, name):
    assert "skew=true" in executed_plan(CATALOG[name](spark, skewed))


def hottest(df, key):
    counts = df.groupBy(key).count()
    return counts.agg(F.max("count")).collect()[0][0]


def test_grains_hold_a_hot_key_in_one_row(spark, skewed):
    from saleslens.plans import frames
    from saleslens.sources.retail import Retail

    data = Retail(spark, skewed)
    assert hottest(data.lines(), "product_id") > 19000
    assert hottest(frames.product_sales(data), "product_id") == 1
    assert hottest(data.lines(), "order_id") > 19000
    assert hottest(frames.order_sales(data), "order_id") == 1
    assert hottest(frames.staff_sales(data), "staff_id") == 1
    assert hottest(frames.customer_rows(data), "customer_id") == 1
