"""Load a star from a directory of Parquet tables (one file or folder ``<table>.parquet`` each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.sources.schemas import SHOP_TABLES, WAREHOUSE_TABLES, Columns


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as its files are now: nothing is kept, so later reads see appended files."""
    return spark.read.parquet(path)


def conform(df: DataFrame, columns: Columns, name: str) -> DataFrame:
    """Only the declared columns, in the declared types; a missing column is an error now rather
    than a column of nulls later."""
    missing = [column for column in columns if column not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks columns: {', '.join(missing)}")
    return df.select([_held(df, column, kind, name) for column, kind in columns.items()])


def _held(df: DataFrame, column: str, kind: str, name: str) -> Column:
    """The column in the declared type. A value that the type can't hold is an error that names
    the table and column, never a rounded or shortened value."""
    stored, wanted = F.col(column), F.col(column).try_cast(kind)
    source = df.schema[column].dataType
    if source.simpleString() == kind or kind == "string":
        return wanted.alias(column)
    same = F.coalesce(wanted.try_cast(source) == stored, F.lit(False))
    message = F.concat(F.lit(f"{name}.{column} can't be held as {kind}: "), stored.cast("string"))
    return F.when(stored.isNull() | same, wanted).otherwise(F.raise_error(message)).alias(column)


def load_tables(
    spark: SparkSession, path: str, schemas: dict[str, Columns]
) -> dict[str, DataFrame]:
    return {
        name: conform(open_table(spark, f"{path}/{name}.parquet"), columns, name)
        for name, columns in schemas.items()
    }


def load_shop(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The eight tables of the bike-shop star."""
    return load_tables(spark, path, SHOP_TABLES)


def load_warehouse(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five tables of the general sales star."""
    return load_tables(spark, path, WAREHOUSE_TABLES)
