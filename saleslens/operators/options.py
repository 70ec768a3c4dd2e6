"""Choices a report offers, and a look at the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREVIEW_ROWS = 5


def filter_options(*sources: tuple[DataFrame, dict[str, str]]) -> DataFrame:
    """Distinct known values of several columns as one long frame ``field``, ``value``, ``rank``.

    The rank sorts the values of a field: numbers by size, before all else, and texts by letters.

    Each source names its fields and their columns, and is read once for all of them.
    """
    parts = []
    for df, fields in sources:
        pairs = [
            F.struct(F.lit(field).alias("field"), F.col(column).cast("string").alias("value"))
            for field, column in fields.items()
        ]
        listed = df.select(F.inline(F.array(*pairs)))
        parts.append(listed.filter(F.col("value").isNotNull()).distinct())
    by_size = F.col("value").try_cast("double").asc_nulls_last()
    place = F.row_number().over(Window.partitionBy("field").orderBy(by_size, "value"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", place)


def heads(df: DataFrame, key: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """The rows with the ``n`` least values of ``key``, repeated ones counted: the key is sorted alone,
    and whole records are fetched for what is found."""
    least = df.select(key).orderBy(key).limit(n).distinct()
    same = least.withColumnRenamed(key, "least")
    return df.join(same, F.col(key).eqNullSafe(F.col("least")), "left_semi")


def table_preview(tables: dict[str, DataFrame], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows of each table, as text, ordered by its columns from the left. A large
    table comes as its ``heads``."""
    parts = []
    for name, df in tables.items():
        head = df.orderBy(*df.columns).limit(n)
        record = [F.coalesce(F.col(column).cast("string"), F.lit("-")) for column in df.columns]
        parts.append(head.select(F.lit(name).alias("table_name"), F.concat_ws("|", *record)))
    return reduce(DataFrame.unionByName, [part.toDF("table_name", "record") for part in parts])
