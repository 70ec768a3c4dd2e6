"""Connected components by alternating stars, for graphs of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import cut


def _towards_least(edges: DataFrame, keep: str) -> DataFrame:
    """Links the neighbours of each node to the least of them and itself; `keep` says which."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    found = edges.join(least, "u")
    if keep == "larger":
        return found.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    lower = found.filter("v <= u")
    return (
        lower.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(lower.select("u", F.col("m").alias("v")))
        .filter("u != v").distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (columns u and v, any order): the least node reachable.

    Each round halves the paths, so that rounds grow with the logarithm of the longest; what a
    round leaves is checkpointed. Minima are combined before the shuffle; the edges of a hub meet
    their minimum in a plain join that adaptive execution may split, as what follows shuffles anew.
    """
    edges = cut(links.select("u", "v").filter("u != v").distinct())
    signature = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_towards_least(both, "larger"))
        downwards = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = cut(_towards_least(downwards, "smaller"))
        now = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        ).first()
        if signature == (now.n, now.s):
            return edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root")).union(
                edges.select(F.least("u", "v").alias("node"), F.least("u", "v").alias("root"))
            ).distinct()
        signature = (now.n, now.s)
