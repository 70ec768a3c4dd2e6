"""Hard negatives by a vertical scan of vectors (BOND).

Vectors become blocks of columns: a block holds some thousand rows, dimension by dimension, with the
least and largest value of each. For an anchor the dimensions are read in descending order of its own
magnitudes. What the dimensions not yet read can still add lies between bounds made of the block's
least and largest values, so every row has a lower and an upper bound of its score. A bitmap holds
the rows that can still be in the result; bounds shrink it after each stretch of dimensions, and
what is left has its exact score at the end. All anchors are run against all rows, in pairs of an
anchor group and a block; only the few best of each pair are shuffled and merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saleslens.llm.common import stored

#: Scale of the components, other labels, anchors, positives and negatives.
SCALE = 256
SHIFTED, LABELS = 7, 10
ANCHORS = 50
POSITIVES = 5
NEGATIVES = 3
#: A negative has from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Rows of a block, anchors of a group, and dimensions between two cuts of the bitmap.
BLOCK = 4096
GROUP = 1024
STRETCH = 8
#: Sums up to here are exact in doubles.
EXACT = 1 << 53

BLOCKS = "block int, rows binary, ids binary, labels binary, width int, columns binary"
GROUPS = "anchors int, rows binary, ids binary, labels binary, width int, columns binary, scores binary"


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, label, vector: whole numbers, of the rows that take part.

    Null ids, labels, vectors and components and components that aren't finite take no part. The
    label of every SHIFTED-th id is moved on by one.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = table.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    label = F.col("label").cast("bigint")
    return rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.when(F.pmod("vec_id", F.lit(SHIFTED)) == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("vector"),
    )


def _packed(number: int, rows, ids, labels, vectors, extra=()) -> pa.RecordBatch:
    """One record with the rows' vectors by column; shorter vectors end in zeros."""
    width = max(map(len, vectors))
    columns = np.zeros((width, len(vectors)), dtype=np.int64)
    for k, vector in enumerate(vectors):
        columns[: len(vector), k] = vector
    blobs = (np.asarray(x, dtype=np.int64).tobytes() for x in (rows, ids, labels))
    values = [number, *blobs, width, columns.tobytes(), *extra]
    names = [field.split()[0] for field in (GROUPS if extra else BLOCKS).split(", ")]
    kinds = [pa.int32() if name in ("block", "anchors", "width") else pa.binary() for name in names]
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as one block; a row's number is made of its block and its place there."""
    number, ids, labels, found = TaskContext.get().partitionId(), [], [], []
    for batch in batches:
        ids += batch.column("vec_id").to_pylist()
        labels += batch.column("label").to_pylist()
        found += [np.asarray(v) for v in batch.column("vector").to_numpy(zero_copy_only=False)]
    if ids:
        yield _packed(number, (number << 32) + np.arange(len(ids)), ids, labels, found)


class Columns:
    """A block or an anchor group as numpy arrays."""

    def __init__(self, record: dict):
        self.rows, self.ids, self.labels = (
            np.frombuffer(record[name], dtype=np.int64) for name in ("rows", "ids", "labels")
        )
        self.columns = np.frombuffer(record["columns"], dtype=np.int64).reshape(record["width"], len(self.rows))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, vec_id, label, vector of the anchors in the blocks."""
    for batch in batches:
        for record in batch.to_pylist():
            block = Columns(record)
            at = np.flatnonzero(block.ids % ANCHORS == 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.rows[at]), pa.array(block.ids[at]), pa.array(block.labels[at]),
                    pa.array(list(block.columns[:, at].T), pa.list_(pa.int64())),
                ],
                ["row", "vec_id", "label", "vector"],
            )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of a task as one group, with POSITIVES scores of positives each, -1 for none."""
    number, rows, ids, labels, found, scores = TaskContext.get().partitionId(), [], [], [], [], []
    for batch in batches:
        rows += batch.column("row").to_pylist()
        ids += batch.column("vec_id").to_pylist()
        labels += batch.column("label").to_pylist()
        found += [np.asarray(v) for v in batch.column("vector").to_numpy(zero_copy_only=False)]
        scores += [(s + [-1] * POSITIVES)[:POSITIVES] for s in batch.column("scores").to_pylist()]
    if rows:
        yield _packed(number, rows, ids, labels, found, (np.asarray(scores, np.int64).tobytes(),))


class Scan:
    """Scores of a block's rows for one anchor, read dimension by dimension."""

    def __init__(self, block: Columns, anchors: Columns):
        width = min(len(block.columns), len(anchors.columns))
        # a dimension that one side lacks is zero there
        self.columns, self.queries = block.columns[:width], anchors.columns[:width].T
        self.least, self.most = self.columns.min(axis=1, initial=0), self.columns.max(axis=1, initial=0)
        largest = max(abs(int(self.columns.min(initial=0))), int(self.columns.max(initial=0)))
        reach = max(abs(int(self.queries.min(initial=0))), int(self.queries.max(initial=0)))
        if largest * reach * max(width, 1) >= 1 << 63:
            raise OverflowError("a score can exceed 63 bits")
        self.kind = np.float64 if largest * reach * max(width, 1) < EXACT else np.int64
        self.columns = self.columns.astype(self.kind)

    def run(self, anchor: int, rows: np.ndarray, cut: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Those of `rows` that cut(lower, upper, rows) leaves after each stretch, and their scores."""
        query = self.queries[anchor].astype(self.kind)
        order = np.argsort(-np.abs(query), kind="stable")
        ends = np.stack([query * self.least, query * self.most])[:, order]
        # what the dimensions from each place on add at least and at most
        low = np.r_[np.cumsum(ends.min(axis=0)[::-1])[::-1], 0]
        high = np.r_[np.cumsum(ends.max(axis=0)[::-1])[::-1], 0]
        score = np.zeros(len(rows), dtype=self.kind)
        for at in range(0, len(order), STRETCH):
            dims = order[at : at + STRETCH]
            read = self.columns[dims]
            score += query[dims] @ (read if len(rows) == read.shape[1] else read[:, rows])
            end = min(at + STRETCH, len(order))
            stays = cut(score + low[end], score + high[end], rows)
            if not stays.all():
                rows, score = rows[stays], score[stays]
            if not len(rows):
                break
        return rows, score.astype(np.int64)


def _largest(values: np.ndarray, n: int):
    """The n-th largest, or less than all if there are fewer."""
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -np.inf


def _best(block: Columns, rows: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first by score, then id."""
    return np.lexsort((block.ids[rows], -score))[:n]


def _nearest(block: Columns, anchors: Columns) -> list[tuple]:
    """anchor, score, vec_id of the best rows of each anchor's label in the block."""
    scan, out = Scan(block, anchors), []
    by_label = {int(label): np.flatnonzero(block.labels == label) for label in np.unique(anchors.labels)}
    for k, label in enumerate(anchors.labels.tolist()):
        rows = by_label[label]
        rows = rows[block.rows[rows] != anchors.rows[k]]

        def cut(lower: np.ndarray, upper: np.ndarray, _: np.ndarray) -> np.ndarray:
            return upper >= _largest(lower, POSITIVES)

        rows, score = scan.run(k, rows, cut)
        out += [
            (int(anchors.rows[k]), int(score[i]), int(block.ids[rows[i]])) for i in _best(block, rows, score, POSITIVES)
        ]
    return out


def window(score: int) -> tuple[int, int]:
    """Least and largest score of a negative of a positive with this score; empty below 0."""
    return -(-LOW * score // 100), HIGH * score // 100


def _negatives(scores: bytes) -> Callable[[Columns, Columns], list[tuple]]:
    def found(block: Columns, anchors: Columns) -> list[tuple]:
        """anchor, score of the positive, score, vec_id: the best of each window in the block."""
        scan, out = Scan(block, anchors), []
        wanted = np.frombuffer(scores, dtype=np.int64).reshape(len(anchors.rows), POSITIVES)
        others = {int(label): np.flatnonzero(block.labels != label) for label in np.unique(anchors.labels)}
        for k, label in enumerate(anchors.labels.tolist()):
            positives = sorted({int(s) for s in wanted[k] if s >= 0})
            windows = [window(s) for s in positives]
            if not windows:
                continue

            def cut(lower: np.ndarray, upper: np.ndarray, _: np.ndarray) -> np.ndarray:
                stays = np.zeros(len(lower), dtype=bool)
                for low, high in windows:
                    inside = lower[(lower >= low) & (upper <= high)]
                    # no row below the last of so many that surely lie in the window is needed
                    stays |= (upper >= max(low, _largest(inside, NEGATIVES))) & (lower <= high)
                return stays

            rows, score = scan.run(k, others[label], cut)
            for positive, (low, high) in zip(positives, windows):
                at = np.flatnonzero((score >= low) & (score <= high))
                at = at[_best(block, rows[at], score[at], NEGATIVES)]
                out += [(int(anchors.rows[k]), positive, int(score[i]), int(block.ids[rows[i]])) for i in at]
        return out

    return found


def _parts(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of about BLOCK rows, dealt evenly. rows: as vectors gives."""
    return stored(rows.repartition(_parts(rows, BLOCK)).mapInArrow(_blocks, BLOCKS))


def groups(anchors: DataFrame) -> DataFrame:
    """Groups of about GROUP anchors. anchors: row, vec_id, label, vector, scores."""
    return stored(anchors.repartition(_parts(anchors, GROUP)).mapInArrow(_groups, GROUPS))


def _paired(held: DataFrame, grouped: DataFrame, found: Callable, schema: str) -> DataFrame:
    """What `found` gives for every block with every group: a task takes one pair at a time."""
    numbers = [frame.agg(F.coalesce(F.max(name), F.lit(-1))).first()[0] for frame, name in ((held, "block"), (grouped, "anchors"))]
    left = held.withColumn("anchors", F.explode(F.sequence(F.lit(0), F.lit(max(numbers[1], 0)))))
    right = grouped.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(numbers[0], 0)))))
    kinds = [pa.int64()] * len(schema.split(","))
    names = [field.split()[0] for field in schema.split(", ")]

    def run(block: pa.Table, group: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and group.num_rows:
            one = group.to_pylist()[0]
            out = found(one["scores"])(Columns(block.to_pylist()[0]), Columns(one))
        columns = zip(*out) if out else [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    keys = ["block", "anchors"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _first(rows: DataFrame, n: int, score: str, vec_id: str, *keys: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc(score), vec_id)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mined(table: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows take part as `vectors` says. Shorter vectors count as if they ended in zeros. Repeated
    rows are rows of their own: a copy of an anchor is one of its positives, and an anchor itself.
    A positive with a negative score has no negatives, one with score 0 those with score 0. Scores
    that may exceed 63 bits are an error.
    """
    held = blocks(vectors(table))
    anchors = stored(held.mapInArrow(_anchors, "row long, vec_id long, label long, vector array<long>"))
    none = F.array().cast("array<bigint>")
    near = _paired(
        held, groups(anchors.withColumn("scores", none)), lambda _: _nearest, "row long, positive_score long, positive_id long"
    )
    positives = stored(_first(near, POSITIVES, "positive_score", "positive_id", "row").drop("rank"))
    scores = positives.groupBy("row").agg(F.collect_list("positive_score").alias("scores"))
    hard = _paired(
        held, groups(anchors.join(scores, "row")), _negatives,
        "row long, positive_score long, negative_score long, negative_id long",
    )
    negatives = _first(hard, NEGATIVES, "negative_score", "negative_id", "row", "positive_score")
    named = positives.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.join(negatives, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )
