"""URL verdicts: fixed rules first, then trust and distrust propagated over the host graph.

Built-in functions only. Trust starts at hosts with pages that a rule allows and follows links;
distrust starts at hosts with pages that a rule blocks and follows links backwards, to those who
link there. Both are personalised PageRanks. A host also stands in for the domain it belongs to, as
an edge each way, since pages of a site often link within it only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import ascii_lower, cut, stored

#: Host, path and verdict of each rule.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DAMPING = 0.85
#: After so many rounds less than 1 % of a rank is still to move.
ROUNDS = 30
#: Digits that a rank is rounded to, however small it is.
DIGITS = 12
#: A host is blocked if its distrust exceeds its trust this many times.
MARGIN = 1.0
#: Edges of a host that lie together; a host with more is spread over several parts.
TOGETHER = 1 << 16
#: Weight of the edges between a host and its domain, in links.
DOMAIN_WEIGHT = 1.0


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null without one."""

    def fits(rule) -> Column:
        own, below, _ = rule
        return ((host == own) | host.endswith(f".{own}")) & path.startswith(below)

    longest = sorted(rules, key=lambda rule: -len(rule[0] + rule[1]))
    if not longest:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return (
        F.coalesce(*(F.when(fits(rule), F.lit(rule[0] + rule[1])) for rule in longest)),
        F.coalesce(*(F.when(fits(rule), F.lit(rule[2])) for rule in longest)),
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """u, v, w: links from pages of host u to host v, w in number. Relative links stay on the host."""
    href = r"""(?i)\bhref\s*=\s*["']?((?:[^"'\s>]+:)?//[^"'\s>]+)"""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(href), F.lit(1))
    each = pages.select(host_of(F.col("url")).alias("u"), F.explode(targets).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    each = each.select("u", host_of(full).alias("v")).filter("u != '' and v != '' and u != v")
    return each.groupBy("u", "v").agg(F.count("*").cast("double").alias("w"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """u, v, w: each host and each of its domains of two labels or more, linked to the next both ways."""
    parts = F.split("host", r"\.")
    chain = F.when(
        F.size(parts) >= 2,
        F.transform(
            F.sequence(F.lit(0), F.size(parts) - 2),
            lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "."),
        ),
    ).otherwise(F.array().cast("array<string>"))
    pairs = F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1).alias("a"), F.slice("chain", F.lit(2), F.size("chain")).alias("b"))
    up = (
        hosts.select(chain.alias("chain")).filter(F.size("chain") > 1)
        .select(F.inline(pairs)).distinct()
    )
    weight = F.lit(DOMAIN_WEIGHT).alias("w")
    return up.select(F.col("a").alias("u"), F.col("b").alias("v"), weight).union(
        up.select(F.col("b").alias("u"), F.col("a").alias("v"), weight)
    )


def significant(x: Column) -> Column:
    """x > 0 with DIGITS digits."""
    scale = F.pow(F.lit(10.0), DIGITS - 1 - F.floor(F.log10(x)))
    return F.round(x * scale) / scale


def propagated(edges: DataFrame, seeds: DataFrame, together: int = TOGETHER) -> DataFrame:
    """host, trust, distrust after ROUNDS rounds. edges: u, v, w; seeds: host, trusted, blocked >= 0.

    Both kinds of rank travel in one table; distrust takes the edges backwards. Edges stay where
    their host's rank comes to; a host with more than `together` of them is spread over parts, and
    its rank is sent to each. Ranks are rounded to DIGITS digits, so that the order of addition does
    not show and a rank however small stays above 0.
    """
    forward = edges.groupBy("u", "v").agg(F.sum("w").alias("w"))
    both = forward.select(F.lit("trust").alias("kind"), "u", "v", "w").union(
        forward.select(F.lit("distrust").alias("kind"), F.col("v").alias("u"), F.col("u").alias("v"), "w")
    )
    parts = F.ceil(F.count("*") / F.lit(together)).cast("int")
    degrees = cut(both.groupBy("kind", "u").agg(F.sum("w").alias("all"), parts.alias("parts")))
    flows = cut(
        both.join(degrees, ["kind", "u"])
        .select(
            "kind", "u", "v", (F.col("w") / F.col("all")).alias("flow"),
            F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"),
        )
        .repartition("kind", "u", "part")
    )
    hubs = cut(degrees.filter("parts > 1").select("kind", F.col("u").alias("host"), "parts"))
    split = seeds.select("host", F.inline(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("trusted").cast("double").alias("n")),
        F.struct(F.lit("distrust").alias("kind"), F.col("blocked").cast("double").alias("n")),
    ))).filter("n > 0")
    totals = split.groupBy("kind").agg(F.sum("n").alias("all"))
    start = cut(split.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("rank")))
    ranks = start
    last = F.coalesce("parts", F.lit(1)) - 1
    for k in range(ROUNDS):
        sent = ranks.join(hubs, ["kind", "host"], "left").select(
            "kind", F.col("host").alias("u"), "rank", F.explode(F.sequence(F.lit(0), last)).alias("part")
        )
        moved = flows.join(sent, ["kind", "u", "part"]).select(
            "kind", F.col("v").alias("host"), (DAMPING * F.col("flow") * F.col("rank")).alias("rank")
        )
        kept = start.select("kind", "host", ((1 - DAMPING) * F.col("rank")).alias("rank"))
        ranks = moved.union(kept).groupBy("kind", "host").agg(significant(F.sum("rank")).alias("rank"))
        if k % 5 == 4:
            ranks = cut(ranks)
    return ranks.groupBy("host").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.max(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0)).alias("distrust"),
    )


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust.

    A url that is null or has no `://` has an empty host and path and is allowed, as is every page
    without a rule on a host that neither rank reaches. Repeated rows come out as they came in.
    """
    rows = stored(_ruled(pages, F.col("page_id"), rules))
    return _judged(rows, _ranks(rows, pages)).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def _ruled(pages: DataFrame, kept: Column, rules) -> DataFrame:
    """kept, host, path, rule and the rule's verdict."""
    rows = pages.select(kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "ruled": verdict})


def _ranks(rows: DataFrame, pages: DataFrame) -> DataFrame:
    seeds = cut(rows.filter("host != ''").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").alias("trusted"),
        F.count_if(F.col("ruled") == "block").alias("blocked"),
    ))
    return propagated(link_edges(pages).union(domain_edges(seeds.select("host"))), seeds)


def _judged(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    joined = rows.join(ranks, "host", "left")
    distrusted = F.coalesce(F.col("distrust") > MARGIN * F.col("trust"), F.lit(False))
    return joined.withColumns({
        "verdict": F.coalesce("ruled", F.when(distrusted, "block").otherwise("allow")),
        "trust": F.coalesce("trust", F.lit(0.0)),
        "distrust": F.coalesce("distrust", F.lit(0.0)),
    })


def allowed(pages: DataFrame, rules=RULES) -> DataFrame:
    """The pages that are allowed, with all their columns; each row is judged for itself, whatever
    its page_id."""
    ranks = stored(_ranks(stored(_ruled(pages, F.lit(0).alias("kept"), rules)), pages))
    whole = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page")
    return _judged(_ruled(pages, whole, rules), ranks).filter("verdict = 'allow'").select("page.*")
