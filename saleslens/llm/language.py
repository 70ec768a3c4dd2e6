"""Language mixture of whole texts by expectation-maximisation over n-gram likelihoods.

Training counts byte trigrams of lower-cased words per language. A text is a mixture: each word
comes from one language with that language's share, and its likelihood is the product of its
trigrams'. EM estimates the shares; the set of languages grows by the next largest share for as
long as the penalised likelihood rises. Texts are scored where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.bytewise import LETTERS, LOWER, blocks, words
from saleslens.llm.common import cut

BUCKETS = 1 << 16
BLOCK_BYTES = 2 << 20
ROUNDS = 8
#: Log-likelihood that each further language must add, times the log of the number of words.
PENALTY = 3.0
#: Count added to each trigram of each language.
SMOOTHING = 0.05
#: Languages of a model, 256 kB each, as a model goes to every task whole: those with most trigrams.
MAX_LANGUAGES = 128


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all bytes in words; where each word's begin; the text of each word."""
    start, end, text = words(data, offsets, LETTERS)
    inside = LETTERS[data]
    code = np.where(inside, LOWER[data], 32).astype(np.uint32)
    before, after = np.r_[np.uint32(32), code[:-1]], np.r_[code[1:], np.uint32(32)]
    before[start] = 32
    after[end - 1] = 32
    joined = (before << 16 | code << 8 | after)[inside]
    size = end - start
    return (joined * np.uint32(2654435769)) >> np.uint32(16), np.cumsum(size) - size, text


class Model:
    """languages, and log_p[bucket, language]."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.log_p = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for name, count in counts.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(count[at])],
                ["language", "bucket", "n"],
            )
        counts.clear()

    for batch in batches:
        code = batch.column("language").dictionary_encode()
        names, code = code.dictionary.to_pylist(), np.asarray(code.indices)
        for row, _, data, offsets in blocks(batch.column("body"), BLOCK_BYTES):
            bucket, begin, text = trigrams(data, offsets)
            spread = np.repeat(code[row + text], np.diff(np.r_[begin, len(bucket)]))
            for k in np.unique(spread):
                own = counts.setdefault(names[k], np.zeros(BUCKETS, np.int64))
                own += np.bincount(bucket[spread == k], minlength=BUCKETS)
            if len(counts) > 64:
                yield from rows()
    yield from rows()


def fit(docs: DataFrame, chosen: Column, text: str = "text", language: str = "lang") -> Model:
    """A model of the rows where `chosen` holds and neither text nor language is null.

    Counts cover all such rows; what reaches the driver is at most one count per bucket and
    language. Languages whose texts hold no letters are not learned, nor are, of more than
    MAX_LANGUAGES values of `language`, those with the fewest trigrams (ties: last by name).
    """
    rows = docs.filter(chosen & F.col(text).isNotNull() & F.col(language).isNotNull()).select(
        F.col(language).cast("string").alias("language"), F.lower(text).alias("body")
    )
    counts = cut(
        rows.mapInArrow(_counted, "language string, bucket long, n long")
        .groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    )
    largest = counts.groupBy("language").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "language")
    names = sorted(row.language for row in largest.limit(MAX_LANGUAGES).collect())
    table = np.zeros((BUCKETS, len(names)))
    if names:
        place = (F.array_position(F.array(*map(F.lit, names)), F.col("language")) - 1).cast("int")
        chosen = counts.filter(F.col("language").isin(names))
        found = chosen.select(place.alias("place"), F.col("bucket").cast("int").alias("bucket"), "n").toArrow()
        bucket, place, n = (found.column(name).to_numpy() for name in ("bucket", "place", "n"))
        table[bucket, place] = n
    return Model(names, table)


def _segments(n: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of each owner begin, and the owners that have rows (rows lie by owner)."""
    have = np.flatnonzero(np.bincount(owner, minlength=n))
    return np.searchsorted(owner, have), have


def shares(log_p: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts: shares of the languages in the chosen set, and words.

    log_p: likelihood of each word in each language; owner: the text of each word, ascending.
    """
    k = log_p.shape[1]
    share = np.zeros((n, k))
    size = np.bincount(owner, minlength=n)
    if len(owner) == 0 or k == 0:
        return share, size
    top = log_p.max(axis=1)
    p = np.exp(np.maximum(log_p - top[:, None], -60.0))

    def em(p: np.ndarray, owner: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, have = _segments(len(pi), owner)
        for _ in range(ROUNDS):
            r = p * pi[owner]
            r /= r.sum(axis=1, keepdims=True)
            pi[have] = np.add.reduceat(r, begin, axis=0) / np.diff(np.r_[begin, len(owner)])[:, None]
        likely = np.zeros(len(pi))
        likely[have] = np.add.reduceat(np.log((p * pi[owner]).sum(axis=1)), begin)
        return pi, likely

    begin, have = _segments(n, owner)
    single = np.zeros((n, k))
    single[have] = np.add.reduceat(log_p - top[:, None], begin, axis=0)
    full, _ = em(p, owner, np.full((n, k), 1.0 / k))
    best = single.argmax(axis=1)
    share[np.arange(n), best] = 1.0
    worth = single.max(axis=1)
    full[np.arange(n), best] = 2.0  # stands first among the candidates
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    live = size > 1
    for m in range(2, k + 1):
        mine = live[owner]
        if not mine.any():
            break
        ids = np.flatnonzero(live)
        local = np.searchsorted(ids, owner[mine])
        pi, likely = em(p[mine], local, np.where(rank[ids] < m, 1.0 / m, 0.0))
        better = likely - PENALTY * np.log(size[ids]) > worth[ids]
        share[ids[better]], worth[ids[better]] = pi[better], (likely - PENALTY * np.log(size[ids]))[better]
        live = np.zeros(n, bool)
        live[ids[better]] = True
    return share, size


MIXTURE = T.StructField(
    "mixture",
    T.StructType()
    .add("language", T.StringType())
    .add("score", T.DoubleType())
    .add("languages", T.ArrayType(T.StringType()))
    .add("shares", T.ArrayType(T.DoubleType()))
    .add("likeness", T.DoubleType()),
)


def likeness(log_p: np.ndarray, share: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each text the mean log-likelihood of a trigram under its mixture, above that of a trigram
    drawn from all alike: below 0 it is like none of the chosen languages. size: trigrams of a word."""
    n = len(share)
    if not log_p.size:
        return np.zeros(n)
    top = log_p.max(axis=1)
    p = (np.exp(np.maximum(log_p - top[:, None], -60.0)) * share[owner]).sum(axis=1)
    total = np.bincount(owner, weights=np.log(np.maximum(p, 1e-30)) + top, minlength=n)
    return total / np.maximum(np.bincount(owner, weights=size, minlength=n), 1) + np.log(BUCKETS)


def _inferred(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        size_of_block = max(1 << 16, BLOCK_BYTES * 16 // max(16, len(model.languages)))
        for batch in batches:
            out = []
            body = batch.column("body")
            for row, end, data, offsets in blocks(body, size_of_block):
                bucket, begin, text = trigrams(data, offsets)
                log_p = np.zeros((len(begin), len(model.languages)), np.float32)
                if len(begin):
                    log_p = np.add.reduceat(model.log_p[bucket], begin, axis=0)
                share, size = shares(log_p, text, end - row)
                like = likeness(log_p, share, text, np.diff(np.r_[begin, len(bucket)]))
                for k in range(end - row):
                    if share.shape[1] == 0 or not size[k] or not any(map(str.isalpha, body[row + k].as_py())):
                        out.append(("und", 0.0, [], [], 0.0))
                        continue
                    order = np.argsort(-share[k], kind="stable")
                    order = order[share[k][order] > 0]
                    out.append((
                        model.languages[order[0]], float(min(share[k][order[0]], 1.0)),
                        [model.languages[j] for j in order], share[k][order].tolist(), float(like[k]),
                    ))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()]
            mixture = pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["language", "score", "languages", "shares", "likeness"],
            )
            yield pa.RecordBatch.from_arrays([batch.column("kept"), mixture], ["kept", "mixture"])

    return run


def infer(docs: DataFrame, model: Model, kept: Column, text: str = "text") -> DataFrame:
    """One row per document: `kept` (any column of docs) and `mixture`.

    mixture.languages and .shares list the chosen set by falling share, .language and .score the
    first, .likeness is what `likeness` gives for the whole set. A text that is null or has no letter
    gets `und`, 0 and empty lists; so does every text if nothing was learned. Equal shares rank by the name of the language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(kept.alias("kept"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    return rows.mapInArrow(_inferred(sent), T.StructType([rows.schema["kept"], MIXTURE]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model may learn from: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (name:share, comma-joined)."""
    out = infer(docs, fit(docs, ~held_out()), F.struct("doc_id"))
    named = F.zip_with(
        "mixture.languages", "mixture.shares", lambda a, b: F.concat(a, F.lit(":"), F.format_number(b, 4))
    )
    return out.select(
        "kept.doc_id",
        held_out("kept.doc_id").alias("held_out"),
        F.col("mixture.language").alias("lang_pred"),
        F.col("mixture.score").alias("score"),
        F.array_join(named, ",").alias("languages"),
    )


def with_language(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """Documents whose mixture of learned languages has a likeness above `least`, with all their
    columns. It does not matter how many languages share a text; one without letters goes."""
    out = infer(docs, model, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    return out.filter((F.col("mixture.language") != "und") & (F.col("mixture.likeness") > least)).select("kept.*")

