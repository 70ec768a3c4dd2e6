"""Exact distinct counts of whole-number keys by mergeable bitmaps.

A key is one bit of the word of 64 neighbouring keys that it lies in. Grouped by word, bitmaps are
combined with OR in each task before the shuffle and after it; then the set bits are counted. Sums
ride along, one for each word. Keys that lie together, as the lines of an order do, leave a task as
a row for 64 keys; keys strewn over all their range leave it as a row for each, as they would for a
distinct count, never as more. (Bitmaps of 32,768 keys, which Spark also has, take 4 kB for a group
with one key in that range, and are grouped by sorting.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, BITS = "key_word", "key_bits"


def word_of(key: str) -> Column:
    return F.shiftright(F.col(key).cast("bigint"), 6)


def bit_of(key: str) -> Column:
    place = F.col(key).cast("bigint").bitwiseAND(63).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def by_word(df: DataFrame, key: str, *groups: str, **sums: Column) -> DataFrame:
    """One row per group and word of ``key``, with its bitmap and the ``sums``. Rows without a key
    keep their sums in a word that is null."""
    measures = [column.alias(name) for name, column in sums.items()]
    placed = df.withColumns({WORD: word_of(key), "key_bit": bit_of(key)})
    return placed.groupBy(*groups, WORD).agg(F.bit_or("key_bit").alias(BITS), *measures)


def keys_in(words: str | Column = BITS) -> Column:
    """Number of distinct keys in the bitmaps of a group, 0 without any."""
    return F.coalesce(F.sum(F.bit_count(words)), F.lit(0)).cast("bigint")


def noted(df: DataFrame, *keys: str) -> DataFrame:
    """kind, word, bitmap: the values of each of the ``keys``, kinds numbered in their order, in one
    pass over ``df``."""
    notes = [
        F.struct(F.lit(k).alias("kind"), word_of(key).alias(WORD), bit_of(key).alias("key_bit"))
        for k, key in enumerate(keys)
    ]
    each = df.select(F.inline(F.array(*notes))).filter(F.col(WORD).isNotNull())
    return each.groupBy("kind", WORD).agg(F.bit_or("key_bit").alias(BITS))


def among(df: DataFrame, key: str, words: DataFrame, kind: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in the bitmaps of ``kind`` that ``noted`` gave."""
    mine = words.filter(F.col("kind") == kind).select(F.col(WORD), F.col(BITS))
    met = df.withColumn("own_word", word_of(key)).join(mine, F.col("own_word") == F.col(WORD))
    return met.filter(F.col(BITS).bitwiseAND(bit_of(key)) != 0).select(*df.columns)


def counts(df: DataFrame, measure: str, *keys: str) -> DataFrame:
    """One row: the sum of ``measure`` and the number of distinct values of each of the ``keys``.

    Each row is read once and noted under every key's word. The notes are combined in the task, so
    what is shuffled are words of each key, not copies of the rows.
    """
    notes = [
        F.struct(
            F.lit(k).alias("kind"), word_of(key).alias(WORD), bit_of(key).alias("key_bit"),
            (F.col(measure) if k == 0 else F.lit(None).cast(df.schema[measure].dataType)).alias(measure),
        )
        for k, key in enumerate(keys)
    ]
    noted = df.select(F.inline(F.array(*notes))).groupBy("kind", WORD)
    words = noted.agg(F.bit_or("key_bit").alias(BITS), F.sum(measure).alias(measure))
    return words.agg(
        F.sum(measure).alias(measure),
        *(keys_in(F.when(F.col("kind") == k, F.col(BITS))).alias(key) for k, key in enumerate(keys)),
    )
