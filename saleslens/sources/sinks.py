"""Write a report out, and share a frame between reports."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from saleslens.sources.schemas import Columns


def write_csv(report: DataFrame, folder: str, prefix: str, files: int | None = None) -> str:
    """Write ``report`` as CSV with a header under a time-stamped name; returns that path.

    The number of part files follows the report's partitions. ``files`` merges them, which is
    only meant for a report known to be small.
    """
    path = f"{folder}/{prefix}_{datetime.now():%Y%m%d_%H%M%S}"
    parts = report if files is None else report.repartition(files)
    parts.write.option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, columns: Columns) -> DataFrame:
    """An export as it was written, in declared types; a value that doesn't fit is an error. Only what
    was written to its end is read: a job that broke off leaves no mark of success."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        raise ValueError(f"{path} was not written to its end")
    shape = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    return spark.read.schema(shape).option("header", True).option("mode", "FAILFAST").csv(path)


@contextmanager
def shared(frame: DataFrame) -> Iterator[DataFrame]:
    """Keep ``frame`` while several reports read it.

    Blocks that do not fit in memory go to disk, and blocks lost with an executor are recomputed
    from the plan.
    """
    kept = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
