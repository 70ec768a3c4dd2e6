"""Checks on the contract of a star: keys that repeat, are missing or lead nowhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The key of each table of the shop star, and where the sales refer to.
KEYS = {
    "fact_sales": "sale_id",
    "dim_customers": "customer_id",
    "dim_staffs": "staff_id",
    "dim_products": "product_id",
    "dim_brands": "brand_id",
    "dim_categories": "category_id",
    "dim_stores": "store_id",
}
REFERENCES = (
    ("fact_sales", "customer_id", "dim_customers"),
    ("fact_sales", "staff_id", "dim_staffs"),
    ("fact_sales", "product_id", "dim_products"),
    ("fact_sales", "store_id", "dim_stores"),
    ("dim_products", "brand_id", "dim_brands"),
    ("dim_products", "category_id", "dim_categories"),
    ("dim_staffs", "store_id", "dim_stores"),
)


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, known, missing, repeated, orphans, in rows of the table.

    ``known`` rows have the key, ``missing`` ones don't; ``repeated`` ones share a table's own key with
    others; ``orphans`` have a key that the dimension lacks. Each table is read once for all of its
    columns and combined to one row per key before keys meet.
    """
    columns = {name: [key] for name, key in KEYS.items()}
    for name, column, _ in REFERENCES:
        columns[name].append(column)
    counted = reduce(DataFrame.unionByName, (_keys(tables[name], name, names) for name, names in columns.items()))
    target = F.create_map(*(F.lit(x) for name, column, dim in REFERENCES for x in (f"{name}.{column}", dim)))
    own = F.create_map(*(F.lit(x) for pair in KEYS.items() for x in pair))
    counted = counted.withColumns({
        "own": F.col("column_name") == F.element_at(own, F.col("table_name")),
        "dim": F.try_element_at(target, F.concat_ws(".", "table_name", "column_name")),
    })
    # a key's rows meet under the dimension that should know it
    at = F.struct(F.coalesce("dim", "table_name").alias("dim"), "key")
    known = counted.filter("own and key is not null").select(at.alias("at")).distinct()
    met = counted.withColumn("at", at).join(known.withColumn("found", F.lit(True)), "at", "left")
    refers = F.col("dim").isNotNull()

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    return met.groupBy("table_name", "column_name").agg(
        rows(F.col("key").isNotNull()).alias("known"),
        rows(F.col("key").isNull()).alias("missing"),
        rows(F.col("own") & F.col("key").isNotNull() & (F.col("rows") > 1)).alias("repeated"),
        rows(refers & F.col("key").isNotNull() & F.col("found").isNull()).alias("orphans"),
    )


def _keys(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """table_name, column_name, key, rows"""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("key")) for c in columns]
    each = df.select(F.lit(name).alias("table_name"), F.inline(F.array(*pairs)))
    return each.groupBy("table_name", "column_name", "key").agg(F.count("*").alias("rows"))


def repeated_keys(dim: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count: each would multiply its sales."""
    return dim.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
