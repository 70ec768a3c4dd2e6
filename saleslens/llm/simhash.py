"""SimHash near-duplicates by a grid range-join over segment popcounts.

A fingerprint is cut into 32 segments of two bits and each segment is mapped to its number of set
bits. The Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints. The counts are kept in unary, so that the distance is a popcount of an XOR.

The grid: the 32 coordinates form six groups; a distance of 3 touches three groups at most, so two
vectors within it agree on all coordinates of at least three. Each vector lies in one cell of each
of the 20 grids over three groups, and close ones share a cell. Within a cell, pairs are
filtered by Manhattan distance, then verified exactly, and only links that join two groups so far
apart are kept: a cell of n fingerprints gives less than n links. A cell with more than
`CELL` fingerprints is cut into blocks, and each pair of blocks is a task's unit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import cut, stored
from saleslens.llm.components import components

SEED = 42
SHINGLE = 3
NEAR = 3
GROUPS = 6
CELL = 2048
#: Hashes whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str) -> int:
    """SimHash over the shingles of a text as an unsigned number; 0 without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    line = b" ".join(words)
    end = np.cumsum([len(word) + 1 for word in words]) - 1
    start = np.r_[0, end[:-1] + 1]
    first, last = start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), CHUNK):
        spans = zip(first[at : at + CHUNK], last[at : at + CHUNK])
        found = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in spans]), np.uint8)
        ones += np.unpackbits(found.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(text.as_py()) for text in batch.column("body")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(found.view(np.int64))], ["kept", "fp"])


def fingerprints(docs: DataFrame, kept: Column, text: str = "text") -> DataFrame:
    """`kept` (any column of docs) and fp, the fingerprint as a signed 64-bit number."""
    rows = docs.select(kept.alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInArrow(_fingerprints, T.StructType([rows.schema["kept"], T.StructField("fp", T.LongType())]))


def unary(fp: Column) -> Column:
    """Segment popcounts in unary: 00, 01 or 11 for none, one or two set bits."""
    low = 0x5555555555555555
    odd = F.shiftright(fp, 1).bitwiseAND(low)
    even = fp.bitwiseAND(low)
    return F.shiftleft(odd.bitwiseAND(even), 1).bitwiseOR(odd.bitwiseOR(even))


def grids() -> list[int]:
    """Masks of the coordinates that each grid compares, as signed 64-bit numbers."""
    edges = [round(32 * k / GROUPS) * 2 for k in range(GROUPS + 1)]
    groups = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(groups, GROUPS - NEAR)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _forest(fps: np.ndarray, others: np.ndarray | None) -> list[tuple[int, int]]:
    """Links between fingerprints within NEAR bits, as many as join their groups and no more."""

    def counts(x: np.ndarray) -> np.ndarray:
        low = np.uint64(0x5555555555555555)
        odd, even = (x >> np.uint64(1)) & low, x & low
        return ((odd & even) << np.uint64(1)) | odd | even

    right = fps if others is None else others
    right_counts = counts(right)
    nodes = {int(x): int(x) for x in np.r_[fps, right]}

    def root(x: int) -> int:
        while nodes[x] != x:
            nodes[x] = nodes[nodes[x]]
            x = nodes[x]
        return x

    links = []
    for at in range(0, len(fps), 256):
        mine = fps[at : at + 256]
        bound = np.bitwise_count(counts(mine)[:, None] ^ right_counts)
        a, b = np.nonzero(bound <= NEAR)
        if others is None:
            later = b > a + at
            a, b = a[later], b[later]
        exact = np.bitwise_count(mine[a] ^ right[b]) <= NEAR
        for x, y in zip(mine[a[exact]].tolist(), right[b[exact]].tolist()):
            p, q = root(x), root(y)
            if p != q:
                nodes[max(p, q)] = min(p, q)
                links.append((x, y))
    return links


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (grid, cell, i, j, block); a unit's rows are gathered, then linked."""
    unit, mine, theirs = None, [], []
    u, v = [], []

    def close() -> None:
        if unit is None:
            return
        own = np.concatenate(mine).astype(np.int64).view(np.uint64) if mine else np.zeros(0, np.uint64)
        if unit[2] == unit[3]:
            found = _forest(own, None) if len(own) > 1 else []
        else:
            found = _forest(own, np.concatenate(theirs).astype(np.int64).view(np.uint64)) if mine and theirs else []
        for x, y in found:
            u.append(x - (1 << 64) if x >= 1 << 63 else x)
            v.append(y - (1 << 64) if y >= 1 << 63 else y)

    for batch in batches:
        keys = [np.asarray(batch.column(name)) for name in ("grid", "cell", "i", "j")]
        block, fp = np.asarray(batch.column("block")), np.asarray(batch.column("fp"))
        change = np.zeros(len(fp), bool)
        for key in keys:
            change[1:] |= key[1:] != key[:-1]
        starts = np.r_[0, np.flatnonzero(change)] if len(fp) else np.zeros(0, int)
        for a, b in zip(starts, np.r_[starts[1:], len(fp)]):
            this = tuple(int(key[a]) for key in keys)
            if this != unit:
                close()
                unit, mine, theirs = this, [], []
            left = block[a:b] == this[2]
            if left.any():
                mine.append(fp[a:b][left])
            if not left.all():
                theirs.append(fp[a:b][~left])
        if len(u) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            u, v = [], []
    close()
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Links u, v that connect exactly the distinct fingerprints `fp` within NEAR bits of each other."""
    masks = F.array(*(F.lit(mask).cast("bigint") for mask in grids()))
    rows = fps.select("fp", F.posexplode(masks).alias("grid", "mask")).select(
        F.col("grid").cast("int").alias("grid"), unary(F.col("fp")).bitwiseAND(F.col("mask")).alias("cell"), "fp"
    )
    sizes = rows.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    shared = rows.join(sizes, ["grid", "cell"]).select(
        "grid", "cell", "fp", blocks.alias("blocks"),
        F.when(blocks > 1, F.pmod(F.xxhash64("fp"), blocks)).otherwise(0).cast("int").alias("block"),
    )
    units = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grid", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp"
    )
    keys = ["grid", "cell", "i", "j"]
    found = units.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return found.mapInArrow(_cells, "u bigint, v bigint")


def classes(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """fp, root for fingerprints that are linked to others: the least of the class, signed."""
    return components(cut(links(fps.select("fp").distinct(), cell))).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, text: str = "text", cell: int = CELL) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id, class_fp (least fingerprint of its class, signed).

    Documents without words have fingerprint zero and are linked like any other. A row with a null
    doc_id is linked, but names no component; component_id is null only where no doc_id is known.
    Repeated rows come out as often as they came in.
    """
    return _named(stored(fingerprints(docs, F.col("doc_id"), text).withColumnRenamed("kept", "doc_id")), cell)


def _named(found: DataFrame, cell: int) -> DataFrame:
    """found: doc_id and fp."""
    least = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = least.join(classes(found, cell), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(names, "root").select("fp", "root", "component_id")
    return found.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("root").alias("class_fp"),
    )


def one_of_each(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id, with all columns.

    Of rows that repeat that doc_id, or of a group without any doc_id, one row stays.
    """
    found = stored(fingerprints(docs, F.col("doc_id")).withColumnRenamed("kept", "doc_id"))
    if found.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        others = _named(found, cell).filter("doc_id != component_id").select("doc_id")
        return docs.join(others, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    # a doc_id alone doesn't tell rows apart: each row carries its fingerprint
    rows = stored(fingerprints(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
    named = _named(rows.withColumn("doc_id", F.col("kept.doc_id")).drop("kept"), cell)
    chosen = named.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    picks = chosen.groupBy("class_fp").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.min("fingerprint").alias("hex")
    )
    picks = picks.withColumn("fp", F.conv("hex", 16, -10).cast("bigint")).select("class_fp", "doc_id", "n", "fp")
    here = rows.join(
        picks.select(F.col("doc_id").alias("pick"), F.col("fp").alias("pick_fp"), "n", "class_fp"),
        F.col("kept.doc_id").eqNullSafe(F.col("pick")) & (F.col("fp") == F.col("pick_fp")),
    )
    single = here.filter("n = 1").select("kept.*")
    repeated = here.filter("n > 1").groupBy("class_fp").agg(F.first("kept").alias("kept")).select("kept.*")
    return single.unionByName(repeated)
