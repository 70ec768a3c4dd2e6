"""Distinct counts by bitmaps against distinct counts."""

import random

import pytest
from pyspark.sql import functions as F

from saleslens.functions import bitmaps

EDGES = [None, 0, -1, 63, 64, -64, -65, 2**62, -(2**63), 2**63 - 1]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(7)
    keys = [*EDGES, *EDGES, *(draw.randrange(-200, 200) for _ in range(500)), *(draw.randrange(2**60) for _ in range(99))]
    data = [(key, draw.choice([1, 2, None]), draw.choice(["a", "b", None]), draw.randrange(100)) for key in keys]
    return spark.createDataFrame(data, "k bigint, j int, g string, x bigint").repartition(5).cache()


def test_keys_per_group(rows):
    words = bitmaps.by_word(rows, "k", "g", x=F.sum("x")).groupBy("g")
    mine = words.agg(bitmaps.keys_in().alias("n"), F.sum("x").alias("x")).collect()
    assert {tuple(r) for r in mine} == {tuple(r) for r in rows.groupBy("g").agg(F.count_distinct("k"), F.sum("x")).collect()}


def test_bitmaps_merge(rows):
    """OR of the bitmaps of two halves is the bitmap of the whole."""
    halves = [bitmaps.by_word(rows.filter(part), "k") for part in ("x < 50", "x >= 50")]
    merged = halves[0].union(halves[1]).groupBy(bitmaps.WORD).agg(F.bit_or(bitmaps.BITS).alias("b"))
    assert merged.agg(bitmaps.keys_in("b")).first()[0] == rows.agg(F.count_distinct("k")).first()[0]


def test_several_keys_in_one_pass(rows):
    mine = bitmaps.counts(rows, "x", "k", "j").first()
    wanted = rows.agg(F.sum("x").alias("x"), F.count_distinct("k").alias("k"), F.count_distinct("j").alias("j")).first()
    assert mine.asDict() == wanted.asDict()


def test_nothing_to_count(rows):
    none = rows.filter(F.lit(False))
    assert bitmaps.counts(none, "x", "k").first().asDict() == {"x": None, "k": 0}
    assert bitmaps.by_word(none, "k", "g").groupBy("g").agg(bitmaps.keys_in()).collect() == []
