"""Secrets, and who else has them.

Built-in functions only. Base patterns find candidates; a looser pattern finds long mixed tokens.
Every candidate is hashed, and the hashes are counted over the corpus by distinct owners and
repositories, where a text that occurs several times counts once. What many owners or very many
repositories share is a copied example; all else that looks random is taken for live: such tokens
are reported as further spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import let, stored


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
#: Patterns of the base spans, the group that is the secret, and its least length.
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of 24 and more are the same spans as all runs without the shorter ones
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: The further kind: long tokens of all three classes, owned by one.
LIVE = ("live", r"[A-Za-z0-9+/_-]{32,}", 0, 32)
KINDS = (*(kind for kind, *_ in BASE), LIVE[0])
#: From so many owners, or so many repositories, on a secret counts as a copied example.
COPIED = 3
MANY = 10
#: Different characters of a token that looks random.
VARIETY = 10
BLOCK = 512


def _running(values: Column) -> Column:
    def grown(part: Column) -> Column:
        return F.aggregate(
            part,
            F.array().cast("array<bigint>"),
            lambda a, x: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x),
        )

    def put_together(parts: Column) -> Column:
        ends = grown(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return let(
            ends,
            lambda e: F.flatten(
                F.transform(parts, lambda p, k: F.transform(p, lambda x: x + F.coalesce(F.get(e, k - 1), F.lit(0))))
            ),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
        lambda k: grown(F.slice(values, k * BLOCK + 1, BLOCK)),
    )
    return let(blocks, put_together)


def running_total(values: Column) -> Column:
    """Sums of the first 1, 2, ... of an array of bigint, summed in blocks so that long arrays stay cheap."""
    return let(
        values, lambda v: F.when(F.size(v) > 0, _running(v)).otherwise(F.array().cast("array<bigint>"))
    )


def matches(body: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """start, kind, end and value of the leftmost matches that do not overlap, in code points."""
    hits = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(body, F.lit(pattern), F.lit(group))

    def placed(hit: Column) -> Column:
        steps = F.zip_with(
            hit,
            F.slice(F.split(body, pattern, -1), F.lit(1), F.size(hit)),
            lambda h, gap: (F.char_length(h) + F.char_length(gap)).cast("bigint"),
        )
        ends = F.zip_with(
            running_total(steps), hit, lambda end, h: F.struct((end - F.char_length(h)).alias("start"), end.alias("end"))
        )
        return F.zip_with(
            ends,
            values,
            lambda e, v: F.struct(
                e["start"].alias("start"), F.lit(kind).alias("kind"), e["end"].alias("end"), v.alias("value")
            ),
        )

    found = F.filter(let(hits, placed), lambda m: F.char_length(m["value"]) >= least)
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint, value: string>>")
    return F.when(body.rlike(pattern), found).otherwise(none)


def candidates(docs: DataFrame, repository: Column, owner: Column, text: str = "text") -> DataFrame:
    """row, doc_id, repository, owner, content (a hash of the text), found: array of start, kind, end, key, random."""
    body = F.coalesce(F.col(text), F.lit(""))
    every = [matches(body, k, *rule[1:]) for k, rule in enumerate((*BASE, LIVE))]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"),
        repository.alias("repository"), owner.alias("owner"), F.md5(body.cast("binary")).alias("content"),
        F.concat(*every).alias("found"),
    )

    def described(m: Column) -> Column:
        value = m["value"]
        mixed = value.rlike("[0-9]") & value.rlike("[a-z]")
        random = mixed & (F.size(F.array_distinct(F.split(value, ""))) >= VARIETY)
        random = random & ((m["kind"] < len(BASE)) | value.rlike("[A-Z]"))
        return F.struct(
            m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"),
            F.sha2(value.cast("binary"), 256).alias("key"), random.alias("random"),
        )

    return rows.withColumn("found", F.transform("found", described))


def ownership(found: DataFrame) -> DataFrame:
    """key, owners, repositories: in how many distinct ones the candidate occurs.

    All rows with the same text are one place, which belongs to the least of their owners and to the
    least of their repositories: a copy of a document neither hides nor multiplies its secrets. A
    null owner counts as one, a null repository not at all. Minima and distinct rows are combined
    before the shuffle.
    """
    each = found.select("owner", "repository", "content", F.explode("found.key").alias("key"))
    places = each.groupBy("key", "content").agg(F.min("owner").alias("owner"), F.min("repository").alias("repository"))
    owners = places.select("key", "owner").distinct().groupBy("key").agg(F.count("*").alias("owners"))
    repositories = places.select("key", "repository").distinct().groupBy("key").agg(F.count("repository").alias("repositories"))
    return owners.join(repositories, "key")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live.

    A null text has no secrets. Each document is a repository and its source the owner. n_copied
    counts spans of candidates in texts of `COPIED` owners or `MANY` repositories at least, n_live
    all others that look random. Base spans are reported in either case.
    """
    found = stored(candidates(docs, F.col("doc_id"), F.col("source")))
    place = F.struct("m.start", "m.kind", "m.end")
    copied = (F.col("owners") >= COPIED) | (F.col("repositories") >= MANY)
    live = F.col("m.random") & ~copied
    extra = (
        found.select("row", F.explode("found").alias("m"))
        .withColumn("key", F.col("m.key"))
        .join(ownership(found), "key")
        .groupBy("row").agg(
            F.count_if(copied).alias("n_copied"),
            F.count_if(live).alias("n_live"),
            F.collect_list(F.when(live & (F.col("m.kind") == len(BASE)), place)).alias("live"),
        )
    )

    def plain(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))

    base = F.filter(F.transform("found", plain), lambda m: m["kind"] < len(BASE))
    rows = found.select("row", "doc_id", base.alias("base")).join(extra, "row", "left")
    outside = F.filter(
        F.coalesce("live", F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")),
        lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
    )

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("bigint")

    return rows.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("base", outside)).alias("spans"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
    )
