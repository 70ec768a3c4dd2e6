"""Quality scores from supervised subword embeddings.

A text is the average of learned vectors of its hashed features: lower-cased words, byte trigrams of
the words as written, and pairs of neighbouring words, where a word that repeats the one before is
one feature of its own. A softmax over a linear layer gives the score. Vectors and layer are trained by
stochastic gradient descent in numpy on a bounded sample; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.bytewise import LOWER, NOT_BLANK, blocks, hashes, words

BUCKETS = 1 << 16
DIMENSIONS = 16
BLOCK_BYTES = 2 << 20
#: Labelled rows to learn from, about; the only rows that are read in part.
SAMPLE = 4000
#: Passes over the sample, and the least number of steps, which few rows are repeated for.
EPOCHS = 5
STEPS = 1500
BATCH = 16
RATE = 0.5
#: Further factor for vectors, since each gets only its feature's share of a gradient.
SPREAD = 16.0
THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts, and the text of each (ascending within each kind of feature)."""
    start, end, text = words(data, offsets, NOT_BLANK)
    if len(start) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = hashes(LOWER[data], start, end)
    again = np.r_[False, (word[1:] == word[:-1]) & (text[1:] == text[:-1])]
    inside = NOT_BLANK[data]
    code = np.where(inside, data, 32).astype(np.uint32)
    before, after = np.r_[np.uint32(32), code[:-1]], np.r_[code[1:], np.uint32(32)]
    before[start], after[end - 1] = 32, 32
    grams = ((before << 16 | code << 8 | after)[inside] * np.uint32(2654435769)) >> np.uint32(16)
    pair = np.where(again, np.uint64(1), np.r_[np.uint64(0), word[:-1]] * np.uint64(3) ^ word)
    pair_bucket = (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return (
        np.concatenate([word >> np.uint64(48), grams.astype(np.uint64), pair_bucket]).astype(np.int64),
        np.concatenate([text, np.repeat(text, end - start), text]),
    )


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as its distinct features and their shares: bounded by the number of buckets."""
    for batch in batches:
        at, share = [], []
        for row, end, data, offsets in blocks(batch.column("body"), BLOCK_BYTES):
            bucket, text = features(data, offsets)
            for k in range(end - row):
                found, n = np.unique(bucket[text == k], return_counts=True)
                at.append(found.astype(np.int32))
                share.append((n / max(n.sum(), 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))],
            ["label", "at", "share"],
        )


class Model:
    """vectors[bucket], and the linear layer of the two classes."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.vectors = (draw.standard_normal((BUCKETS, DIMENSIONS)) / DIMENSIONS).astype(np.float32)
        self.layer = np.zeros((DIMENSIONS, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def train(self, rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> None:
        """rows: class, features, shares. Classes weigh alike, however many rows they have."""
        draw = np.random.default_rng(seed)
        size = np.bincount(np.array([label for label, *_ in rows], dtype=np.int64), minlength=2)
        weight = len(rows) / (2.0 * np.maximum(size, 1))
        per_pass = -(-len(rows) // BATCH)
        passes = max(EPOCHS, -(-STEPS // max(per_pass, 1))) if rows else 0
        steps, step = passes * per_pass, 0
        for _ in range(passes):
            order = draw.permutation(len(rows))
            for first in range(0, len(rows), BATCH):
                chosen = [rows[i] for i in order[first : first + BATCH]]
                rate = RATE * (1 - step / steps)
                step += 1
                self._step(chosen, weight, rate)

    def _step(self, chosen, weight: np.ndarray, rate: float) -> None:
        label = np.array([row[0] for row in chosen])
        hidden = np.stack([share @ self.vectors[at] for _, at, share in chosen])
        p = softmax(hidden @ self.layer + self.bias)
        gap = p.copy()
        gap[np.arange(len(chosen)), label] -= 1
        gap *= (weight[label] / len(chosen))[:, None]
        back = (gap @ self.layer.T).astype(np.float32)
        self.layer -= rate * (hidden.T @ gap).astype(np.float32)
        self.bias -= rate * 0.1 * gap.sum(axis=0).astype(np.float32)
        for (_, at, share), own in zip(chosen, back, strict=True):  # the features of a text are distinct
            self.vectors[at] -= (rate * SPREAD) * share[:, None] * own

    def odds(self) -> np.ndarray:
        """What each feature adds to the logit of class 1: the layer is linear, so the logit of an
        average of vectors is the average of these."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels no model may learn from: crc32 of doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of about `sample` labelled documents that are not held out, chosen by a hash of doc_id.

    Labels other than 0 and 1 and null texts are passed over; of several labels of a document the
    greatest counts. Without any label every text scores a half.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    part = min(sample / max(known.count(), 1), 1.0)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(part * (1 << 40)) + 1)
    # the sample is bounded by its parameter, whatever the size of the tables
    rows = docs.select("doc_id", F.col(text).alias("body")).dropna().join(F.broadcast(chosen), "doc_id")
    found = rows.select("doc_id", "label", "body").mapInArrow(
        _labelled, "doc_id string, label int, at array<int>, share array<float>"
    )
    learned = found.toArrow().sort_by("doc_id").combine_chunks()
    at, share = (learned.column(name).combine_chunks() for name in ("at", "share"))
    model = Model()
    model.train([
        (label, np.asarray(at[k].values), np.asarray(share[k].values))
        for k, label in enumerate(learned.column("label").to_pylist())
    ])
    return model


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.string())
        for out in _sampled([batch.select(["label", "body"])]):
            yield pa.RecordBatch.from_arrays([ids, *out.columns], ["doc_id", *out.schema.names])


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, bias = sent.value
        for batch in batches:
            scores = []
            for row, end, data, offsets in blocks(batch.column("body"), BLOCK_BYTES):
                bucket, text = features(data, offsets)
                n = np.maximum(np.bincount(text, minlength=end - row), 1)
                logit = np.bincount(text, weights=odds[bucket], minlength=end - row) / n + bias
                scores.append(1 / (1 + np.exp(-logit)))
            found = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(found)], ["kept", "score"])

    return run


def score(docs: DataFrame, model: Model, kept: Column, text: str = "text") -> DataFrame:
    """One row per document: `kept` (any column of docs) and score, the probability of class 1.

    Null and empty texts have no features and get the score of the bias.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.odds(), float(model.bias[1] - model.bias[0])))
    rows = docs.select(kept.alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInArrow(_scored(sent), T.StructType([rows.schema["kept"], T.StructField("score", T.DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels), F.col("doc_id")).withColumnRenamed("kept", "doc_id")
    return out.select(
        "doc_id", held_out().alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
