"""Spelling variants of words by partition-and-enumerate signatures.

A word is a multiset of letters, seen as a binary vector with a dimension for each letter and each
count of it. A letter replaced changes two dimensions, one inserted or deleted changes one, so near
words of equal length are within Hamming distance 2 and those of neighbouring lengths within 1. The
dimensions are partitioned by letter into PARTS parts; vectors within distance d agree on all but d
of them, so the signatures of a word are its projections on every choice of PARTS - d parts, with
the length. Words that share a signature meet in an equi-join and are verified by edit distance.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import ascii_lower, cut, stored

#: Letters of words, code points of a word at least, its occurrences at least.
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: One occurrence in so many loses a letter; a form occurs so many times as often.
SLIP = 31
RATIO = 10
#: Parts of the dimensions: more make signatures sharper and more numerous.
PARTS = 6
#: Words of a signature that are compared in one task; those of a larger one are dealt over parts.
CELL = 4096


def words(docs: DataFrame) -> DataFrame:
    """word, n: words of all documents with their occurrences, with the slips of the contract.

    A null text has no words; a null doc_id counts as an empty one in the hash that chooses slips.
    A word needs LEAST_LENGTH letters after its slip, so shorter runs are never taken apart.
    """
    runs = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    each = each.withColumn("run", F.when(ascii_only, F.lower("run")).otherwise(ascii_lower(F.col("run"))))
    each = each.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.pmod(F.col("h"), F.lit(SLIP)) == 0, slipped).otherwise(F.col("run"))
    counted = each.select(word.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word")
    return counted.agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_parts(counted: DataFrame) -> list[str]:
    """The letters of all words in PARTS groups that hold about as many letters of the words each.

    What comes to the driver is a count for each letter of the alphabet.
    """
    letters = counted.select(F.explode(F.split("word", "")).alias("letter")).filter("letter != ''")
    found = letters.groupBy("letter").agg(F.count("*").alias("n")).collect()
    load, parts = [0] * PARTS, [""] * PARTS
    for row in sorted(found, key=lambda row: (-row.n, row.letter)):
        least = load.index(min(load))
        load[least] += row.n
        parts[least] += row.letter
    return parts


def projected(counted: DataFrame) -> DataFrame:
    """word, n, length, part0, part1, ...: the letters that the word has in each part, sorted."""
    parts = letter_parts(counted)
    rows = counted.select("word", "n", F.array_join(F.array_sort(F.split("word", "")), "").alias("letters"))

    def only(part: str) -> Column:
        return F.translate("letters", "".join(c for c in "".join(parts) if c not in part), "")

    return rows.select(
        "word", "n", F.char_length("word").alias("length"),
        *(only(part).alias(f"part{k}") for k, part in enumerate(parts)),
    )


def signed(rows: DataFrame, distance: int, length: Column) -> DataFrame:
    """word, n, signature. Equal signatures of different vectors cost a comparison, no more."""
    every = [
        F.xxhash64(F.lit(k), length, *(F.col(f"part{i}") for i in some))
        for k, some in enumerate(combinations(range(PARTS), PARTS - distance))
    ]
    return rows.select("word", "n", F.explode(F.array(*every)).alias("signature"))


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """word, n, other, other_n of near words that share a signature, each pair once at least.

    The words of a signature with over CELL of them on a side are dealt over parts on the left and
    repeated for each part on the right, so that a common signature is compared by many tasks.
    """
    def others(side: DataFrame) -> DataFrame:
        return side.withColumnsRenamed({"word": "other", "n": "other_n"})

    def near(pairs: DataFrame) -> DataFrame:
        different = (F.col("word") < F.col("other")) if left is right else F.lit(True)
        verified = pairs.filter(different & (F.levenshtein("word", "other", 1) == 1))
        return verified.select("word", "n", "other", "other_n")

    sides = left if left is right else left.union(right)
    parts = F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("parts")
    large = stored(sides.groupBy("signature").agg(parts).filter("parts > 1"))
    if large.isEmpty():
        return near(left.join(others(right), "signature"))
    rest = near(left.join(large, "signature", "left_anti").join(others(right.join(large, "signature", "left_anti")), "signature"))
    dealt = left.join(large, "signature").withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    repeated = others(right).join(large, "signature").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rest.union(near(dealt.join(repeated, ["signature", "part"])))


def near_pairs(counted: DataFrame) -> DataFrame:
    """word, other, other_n: every ordered pair of near words. counted: word and n, each word once."""
    rows = stored(projected(counted))
    length = F.col("length")
    equal = signed(rows, 2, length)
    near = met(equal, equal).union(met(signed(rows, 1, length), signed(rows, 1, length + 1))).distinct()
    return near.select("word", "other", "other_n").union(
        near.select("other", F.col("word").alias("other"), F.col("n").alias("other_n"))
    )


def with_forms(counted: DataFrame) -> DataFrame:
    """Adds n_near, form and form_n: the near word that occurs most, ties by code points, if it
    occurs RATIO times as often as the word at least."""
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    found = near_pairs(counted).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= RATIO * F.col("n")
    return counted.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form: the last form, found by doubling the steps each round.

    Occurrences grow RATIO times with each form, so chains are short and have no rings.
    """
    chain = cut(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        following = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(chain.join(following, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        if longer.filter("next IS NOT NULL").isEmpty():
            return longer.select("word", "root")
        chain = longer.select("word", "root")


def grouped(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    forms = stored(with_forms(stored(words(docs))))
    return forms.join(roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
