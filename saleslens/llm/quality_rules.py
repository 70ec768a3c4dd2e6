"""Quality rules with thresholds that follow each language and source.

Built-in functions only. Measures of every text are taken in one pass. Their distributions are
kept as quantile sketches: logarithmic buckets with a count each, per language, source and measure.
A sketch has a bounded number of buckets, its quantiles a relative error of 2.5 %, and sketches
merge by adding counts, so a source with a third of all rows is combined before the shuffle and
small sources fall back on the merged sketch of their language, then of all, each ratio for itself.
Thresholds are quantiles of the sketches and what they say of the spread, joined to the measures of
the documents: no ratio has a fixed cutoff.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saleslens.llm.common import BLANK, NOT_BLANK, let, stored

WINDOW = 5
#: Growth of a bucket: quantiles are at most half of it off.
GROWTH = 1.05
#: What most documents have alike, or none of them: the fence lies REACH quartile distances from the
#: quartile. A distance is at least a bucket's width, and for symbols OCCURRENCES in a document of
#: the median length, so that quartiles that tie do not reject all the rest.
SPREAD = ("symbols_per_word", "chars_per_word")
TWO_SIDED = ("chars_per_word",)
REACH = 6.0
OCCURRENCES = {"symbols_per_word": 3.0}
#: What some documents have and most have not: the fence lies BEYOND times the quantile TAIL of those
#: that have it.
SOME = ("dup_lines_per_line", "repeat_share")
TAIL = 0.95
BEYOND = 2.0
RATIOS = (*SPREAD, *SOME)
LENGTH = "words"
#: Documents that a sketch needs to speak for a source or a language.
ENOUGH = 50


def _windows(words: Column) -> Column:
    """A hash of the words of each window, in order."""
    return F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Number of words in windows whose hash stands there twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(p: Column) -> Column:
        same = F.filter(
            p,
            lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def total(at: Column) -> Column:
        step = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("bigint"), lambda a, x: a + x)

    found = let(let(placed, again), total)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(F.lit(0).cast("bigint"))


def measured(docs: DataFrame, kept: list[Column], text: str = "text") -> DataFrame:
    """kept, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines. A null text has none
    of all."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *kept,
        F.array_remove(F.split(body, f"{BLANK}+"), "").alias("__words"),
        F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(NOT_BLANK)).alias("__lines"),
    )
    names = [c for c in rows.columns if not c.startswith("__")]
    return rows.select(
        *(F.col(f"`{c}`") for c in names if c != "n_symbols"),
        F.size("__words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        let(let(F.col("__words"), _windows), _covered).alias("n_repeat_words"),
        F.size("__lines").cast("bigint").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The ratios of a text with a word, as doubles; null without."""
    words = F.when(F.col("n_words") > 0, F.col("n_words").cast("double"))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines_per_line": F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines").cast("double")),
        "repeat_share": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


#: Bucket of zero, below that of the least ratio that counts up to 2^63 can have.
ZERO = -2000


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n of the rows that pass the base, with lang, source and the
    measures; one of the ratios is the length in words. SOME have no zeros."""
    values = ratios() | {LENGTH: F.col("n_words").cast("double")}
    named = F.array(*(F.struct(F.lit(k).alias("ratio"), v.alias("value")) for k, v in values.items()))
    each = rows.filter(~base_failed()).select("lang", "source", F.inline(named))
    each = each.filter((F.col("value") > 0) | F.col("ratio").isin(*SPREAD))
    value = F.when(F.col("value") > 0, F.col("value"))
    bucket = F.coalesce(F.floor(F.log(value) / math.log(GROWTH) + 1e-9), F.lit(ZERO)).cast("int")
    return each.groupBy("lang", "source", "ratio", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per key <ratio>_low, <ratio>_high and <ratio>_n, from sketches merged over everything else."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*keys, "ratio")
    upto = whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ranked = merged.select(
        *keys, "ratio", "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all")
    )

    def quantile(q: float) -> Column:
        first = F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bucket")))
        return F.when(first > ZERO, F.pow(F.lit(GROWTH), first + 0.5)).otherwise(0.0)

    found = ranked.groupBy(*keys, "ratio").agg(
        F.max("all").alias("n"), quantile(0.25).alias("q1"), quantile(0.5).alias("q2"),
        quantile(0.75).alias("q3"), quantile(TAIL).alias("tail"),
    )
    wide = found.groupBy(*keys).agg(*(
        F.max(F.when(F.col("ratio") == name, F.col(c))).alias(f"{name}_{c}")
        for name in (*RATIOS, LENGTH) for c in ("n", "q1", "q2", "q3", "tail")
    ))
    limits = []
    for name in RATIOS:
        q1, q3, tail = (F.col(f"{name}_{c}") for c in ("q1", "q3", "tail"))
        reach = REACH * F.greatest(
            q3 - q1, q3 * (GROWTH - 1), F.lit(OCCURRENCES.get(name, 0.0)) / F.col(f"{LENGTH}_q2")
        )
        limits += [
            (q1 - reach if name in TWO_SIDED else F.lit(0.0)).alias(f"{name}_low"),
            (q3 + reach if name in SPREAD else BEYOND * tail).alias(f"{name}_high"),
            F.col(f"{name}_n"),
        ]
    return wide.select(*keys, *limits)


def thresholds(sketch: DataFrame) -> DataFrame:
    """Fences for every lang and source, ratio by ratio: of the source itself if it has enough
    documents (of SOME, with a value above zero), else of its language, else of all. Nulls are a
    language or source of their own."""

    def renamed(level: DataFrame, tag: str) -> DataFrame:
        return level.select([F.col(c).alias(f"{tag}_{c}") for c in level.columns])

    own = renamed(fences(sketch, ["lang", "source"]), "s")
    language = renamed(fences(sketch, ["lang"]), "l")
    every = renamed(fences(sketch.withColumn("one", F.lit(1)), ["one"]), "a")
    joined = own.join(language, F.col("s_lang").eqNullSafe(F.col("l_lang"))).withColumn("one", F.lit(1))
    joined = joined.join(every, F.col("one") == F.col("a_one"))
    return joined.select(
        "s_lang", "s_source",
        *(
            F.when(F.col(f"s_{name}_n") >= ENOUGH, F.col(f"s_{name}_{side}"))
            .when(F.col(f"l_{name}_n") >= ENOUGH, F.col(f"l_{name}_{side}"))
            .otherwise(F.col(f"a_{name}_{side}"))
            .alias(f"{name}_{side}")
            for name in RATIOS
            for side in ("low", "high")
        ),
    )


def _kept(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with `kept`. A ratio that no document has a value of has no fences."""
    joined = rows.join(
        limits,
        F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("source").eqNullSafe(F.col("s_source")),
        "left",
    )
    within = F.lit(True)
    for name, value in ratios().items():
        inside = value.between(F.col(f"{name}_low"), F.col(f"{name}_high"))
        within = within & F.coalesce(inside, F.lit(True))
    return joined.select(*(F.col(c) for c in rows.columns), (~base_failed() & within).alias("kept"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, kept.

    A document is kept unless it fails the base or a ratio lies outside the fences of its language
    and source. A null or empty text fails the base. Repeated rows are judged each for itself.
    """
    rows = stored(measured(docs, [F.col("doc_id"), F.col("lang"), F.col("source")]))
    return _kept(rows, thresholds(sketches(rows))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        base_failed().alias("base_failed"), "kept",
    )


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; each row is judged for itself, whatever
    its doc_id."""
    place = [F.col("lang"), F.col("source")]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    limits = stored(thresholds(sketches(stored(measured(docs, place)))))
    return _kept(measured(docs, [whole, *place]), limits).filter("kept").select("row.*")
