"""Jump consistent hashing of stable keys to shards, without a ring table.

Sizes, checksums and counts are built-in functions; only the jumps run as a vectorised function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import stored

#: Fixed value: multiplier of the generator that jump consistent hashing is published with.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. One shard more moves keys into the new shard only."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), dtype=np.int64)
    ahead = np.zeros(len(key), dtype=np.int64)
    while (live := ahead < shards).any():
        at = np.where(live, ahead, at)
        key = np.where(live, key * MULTIPLIER + np.uint64(1), key)
        draw = (key >> np.uint64(33)).astype(np.float64) + 1.0
        ahead = np.where(live, ((at + 1) * (2147483648.0 / draw)).astype(np.int64), ahead)
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key of any type, null included. Equal keys share a shard."""
    if shards < 1:
        raise ValueError("there must be one shard at least")

    @F.pandas_udf("int")
    def jumped(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).astype(np.uint64), shards))

    return jumped(F.xxhash64(key.cast("string")))


def _numbered(shards: int):
    """Adds the task and a count of the shard's rows within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(shards, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            order = np.argsort(shard, kind="stable")
            size = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), dtype=np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(size) - size, size)
            local += counts[shard]
            counts += size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(local)],
                [*batch.schema.names, "part", "local"],
            )

    return run


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """Adds `slot`, which runs without gaps from 0 in each shard; rows has an int column `shard`.

    Each task counts its own rows; the counts, one per task and shard, give each task its first
    slot. No row is shuffled for it but to meet its task's counts.
    """
    shape = T.StructType([*rows.schema, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    counted = stored(rows.mapInArrow(_numbered(shards), shape))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = counted.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    return counted.join(firsts, ["shard", "part"]).withColumn("slot", F.col("local") + F.col("first")).select(
        *rows.columns, "slot"
    )


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1 and the checksum of no bytes; documents with a null doc_id share a shard,
    as do equal doc_ids.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    return with_slots(rows, shards)


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Writes each shard as a folder shard=K of Parquet files, every task its own files."""
    docs.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)
