"""Mixing sources to target weights by hash thresholds.

Built-in functions only. Every document has a fixed hash of 60 bits. A source whose target is c times
its size and a rest takes each document c times, and once more those whose hash lies below a bound;
bounds of larger targets lie above those of smaller ones, so that mixes are nested. The bound is found
without sorting: sizes are summed by source and leading bits of the hash, the bucket in which the
rest runs out is the boundary bucket, and only its rows are summed again by the next bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saleslens.llm.common import NOT_BLANK, cut, stored

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, and the largest target of a source, in times of the sizes.
SHARE = 1.5
MOST = 2
#: Bits of the hash, and how many of them a histogram tells apart.
BITS = 60
STEP = 12


def size_of(text: Column) -> Column:
    """Words of a text, none of a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{NOT_BLANK}+")), F.lit(0)).cast("bigint")


def hash_of(doc_id: Column, text: Column) -> Column:
    """Fixed for each pair of doc_id and text, whatever the order or number of the rows."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("bigint")


def ranked(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds `weight`, by the rank of `source` in code points, null last.

    The sources stay dealt by ranges: each partition counts its own, and the counts, one per
    partition, give it the rank of its first.
    """
    placed = cut(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    )
    part, local = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumns({"part": part, "local": local}).drop("place")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = placed.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("first") + F.col("local"), F.lit(len(weights))).cast("int"))
    return placed.join(firsts, "part").withColumn("weight", weight.cast("double")).drop("part", "local", "first")


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """source, source_size, target of sources with their source_size.

    Targets are weight times a level, but at most `most` times the size. Each round sets the level
    so that all targets reach `share` of the sizes with the sources over their most held there; the
    level only rises, and it is right once no further source is over.
    """
    rows = cut(
        ranked(sources, weights).withColumn("cap", most * F.col("source_size").cast("double"))
    )
    goal = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("cap")
        now = rows.agg(
            F.count_if(over).alias("held"),
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("caps"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        if now.held == held:
            break
        held = now.held
        level = (goal - now.caps) / now.weights if now.weights else float("inf")
    target = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def _of(source: str) -> Column:
    return F.col("source").eqNullSafe(F.col(source))


def bounds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """of, source_size, target, copies, bound: each document of source `of` is taken `copies` times,
    and once more if its hash is below `bound`. rows: source, size, hash; wanted: as targets gives.

    The taken sizes miss the target by half of one document at most: that at the bound counts if
    the sum is nearer to the target with it. Rows of equal hash are taken alike.
    """
    size = F.col("source_size").cast("double")
    copies = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    wanted = cut(
        wanted.withColumnRenamed("source", "of").withColumn("copies", copies)
        .withColumn("rest", F.col("target") - F.col("copies") * size)
    )
    state = wanted.select("of", "rest", F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("prefix"))
    for shift in range(BITS - STEP, -1, -STEP):
        inside = rows.join(state, _of("of") & (F.shiftright("hash", shift + STEP) == F.col("prefix")))
        sums = inside.groupBy("of", "rest", "below", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("inside"), F.min("hash").alias("first"), F.max("hash").alias("last")
        )
        upto = W.partitionBy("of").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        before = sums.withColumn("below", F.col("below") + F.sum("inside").over(upto) - F.col("inside"))
        state = cut(
            before.filter((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("inside") > F.col("rest")))
            .withColumnRenamed("bucket", "prefix")
        )
        if state.filter("first < last").isEmpty():
            break
    nearer = F.col("inside") < 2 * (F.col("rest") - F.col("below"))
    found = state.select(
        F.col("of").alias("source"), F.when(nearer, F.col("last") + 1).otherwise(F.col("first")).alias("bound")
    )
    # without a boundary bucket all that the source has fits
    return wanted.join(found, _of("of"), "left").select(
        "of", "source_size", "target", "copies", F.coalesce("bound", F.lit(1 << BITS)).alias("bound")
    )


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash"),
    )


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return stored(bounds(rows, targets(sources, weights, share, most)))


def _times() -> Column:
    return F.col("copies") + (F.col("hash") < F.col("bound")).cast("int")


def takes(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document.

    A null source is a source of its own, the last. Null and empty texts have no words, and a
    source without words has target 0. Documents are taken whole, so a source comes as near to its
    target as half of the document at its bound; rows with equal doc_id and text are taken alike.
    """
    rows = stored(_sized(docs))
    joined = rows.join(_plan(rows, weights, share, most), _of("of"))
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _times()).cast("bigint").alias("taken")
    )


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    plan = _plan(stored(_sized(docs)), weights, share, most)
    plan = plan.select(F.struct("of", "copies", "bound").alias("__mix"))
    same = F.col("source").cast("string").eqNullSafe(F.col("__mix.of"))
    times = F.col("__mix.copies") + (hash_of(F.col("doc_id"), F.col("text")) < F.col("__mix.bound")).cast("int")
    return (
        docs.join(plan, same).withColumn("__mix", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
    )
