"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Only a local session may go without: it then gets a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        set_before = spark.sparkContext.getCheckpointDir()
        if set_before is not None:
            return set_before
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='saleslens-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/saleslens-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read from there."""
    path = new_path(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """A copy in buckets of ``key``, sorted within them: groups and joins by the key, whatever else
    they group by, read it without a shuffle. It is an external table of the session's catalog, so
    dropping the table leaves the files to the owner of ``path`` (by default a new shared one)."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"saleslens_{uuid.uuid4().hex}"
    # dealt by the same hash as the buckets are, so that each bucket is one file
    dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    dealt.option("path", path or new_path(spark)).format("parquet").saveAsTable(name)
    return spark.table(name)
