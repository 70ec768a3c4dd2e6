"""Discount ranges: which bin a discount falls in, and the full list of bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bins:
    """Consecutive ranges between ``edges``, closed on one side only."""

    edges: tuple[float, ...]
    labels: tuple[str, ...]
    closed: str

    def ordinal(self, value: Column) -> Column:
        """Position of the bin that holds ``value``; null outside all of them."""
        stored = value.cast("double")
        found = None
        for position, (low, high) in enumerate(zip(self.edges, self.edges[1:])):
            if self.closed == "left":
                inside = (stored >= low) & (stored < high)
            else:
                inside = (stored > low) & (stored <= high)
            found = F.when(inside, position) if found is None else found.when(inside, position)
        return found

    def label(self, ordinal: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.labels)), ordinal + 1)

    def all(self, spark: SparkSession) -> DataFrame:
        """One row per bin, in order."""
        return spark.range(len(self.labels)).select(F.col("id").cast("int").alias("bin"))


# The discount ranges of the two discount reports.
LEFT_CLOSED = Bins(
    edges=(0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 1.0),
    labels=("0-5%", "5-10%", "10-15%", "15-20%", "20-25%", "25%+"),
    closed="left",
)
RIGHT_CLOSED = Bins(
    edges=(-0.01, 0.05, 0.10, 0.15, 0.20),
    labels=("0-5%", "5-10%", "10-15%", "15-20%"),
    closed="right",
)
