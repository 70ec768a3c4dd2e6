"""Joins, filters and aggregates, each a plain ``DataFrame -> DataFrame`` function.

Nothing here collects, caches or runs a job. Joins carry no hints except where a side has a size
that is bounded by definition (calendar days, discount bins); elsewhere Spark picks the strategy
from the sizes it measures.
"""
