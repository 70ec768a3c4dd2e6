"""DuckDB twins of the operators that SQL can express, written from the contracts alone.

Language inference, the classifier, fingerprints, packing, surrogates, jump hashing and spelling
variants have none;
tests/llm holds them against brute force, round trips and held-out accuracy.
"""

from __future__ import annotations

from saleslens.llm import link_trust, mixing, quality_rules, secret_scan
from saleslens.llm.common import NOT_BLANK, UPPER

_ITEM_WORDS = (
    rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP1 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w, row_number() OVER () AS r FROM benchmark),
b2 AS (SELECT item, r, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
every_window AS (
  SELECT item, r, k, i AS j, array_to_string(w[i + 1 : i + k], ' ') AS s
  FROM (SELECT item, r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM b2)
),
windows AS (SELECT DISTINCT item, k, s FROM every_window),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)
),
hits AS (SELECT doc_id, i, k, item FROM places JOIN windows USING (k, s)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id
),
steps AS (
  SELECT doc_id, r, i, k, i - j AS diagonal,
    i - row_number() OVER (PARTITION BY doc_id, r, i - j ORDER BY i) AS run
  FROM places JOIN every_window USING (k, s)
),
matches AS (
  SELECT doc_id, count(*) + any_value(k) - 1 AS longest_match, min(i) AS longest_at
  FROM steps GROUP BY doc_id, r, diagonal, run
),
longest AS (
  SELECT * FROM matches
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY longest_match DESC, longest_at) = 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match, longest_at
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

_VALUES = {
    "symbols_per_word": "n_symbols / n_words",
    "dup_lines_per_line": "n_dup_lines / nullif(n_lines, 0)",
    "repeat_share": "n_repeat_words / n_words",
    "chars_per_word": "word_chars / n_words",
}


def _fences(level: str, keys: str) -> str:
    """Fences of each ratio from its quantiles, for rows with the same keys."""
    listed = f"{keys}, " if keys else ""
    g = quality_rules.GROWTH

    def quantile(q: float) -> str:
        first = f"min(bucket) FILTER (upto >= {q} * every)"
        return f"CASE WHEN {first} > {quality_rules.ZERO} THEN pow({g}, {first} + 0.5) ELSE 0.0 END"

    def among(names) -> str:
        return "ratio IN (" + ", ".join(f"'{x}'" for x in names) + ")"

    occurrences = " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality_rules.OCCURRENCES.items())
    together = " AND ".join(f"a.{x} IS NOT DISTINCT FROM b.{x}" for x in keys.split(", ")) if keys else "true"
    part = f"PARTITION BY {listed}ratio"
    return f"""
{level}_counts AS (SELECT {listed}ratio, bucket, sum(n) AS n FROM sketch GROUP BY {listed}ratio, bucket),
{level}_ranked AS (
  SELECT {listed}ratio, bucket, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS every
  FROM {level}_counts
),
{level}_quantiles AS (
  SELECT {listed}ratio, max(every) AS n, {quantile(0.25)} AS q1, {quantile(0.5)} AS q2, {quantile(0.75)} AS q3,
    {quantile(quality_rules.TAIL)} AS tail
  FROM {level}_ranked GROUP BY {listed}ratio
),
{level}_reached AS (
  SELECT a.*, {quality_rules.REACH} * greatest(a.q3 - a.q1, a.q3 * {g - 1},
    CASE a.ratio {occurrences} ELSE 0.0 END / b.q2) AS reach
  FROM {level}_quantiles a JOIN {level}_quantiles b ON b.ratio = '{quality_rules.LENGTH}' AND {together}
),
{level} AS (
  SELECT {listed}ratio, n, CASE WHEN {among(quality_rules.TWO_SIDED)} THEN q1 - reach ELSE 0.0 END AS low,
    CASE WHEN {among(quality_rules.SPREAD)} THEN q3 + reach ELSE {quality_rules.BEYOND} * tail END AS high
  FROM {level}_reached
)"""


OP3 = rf"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '{NOT_BLANK}+') AS w
  FROM documents
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '{NOT_BLANK}') GROUP BY doc_id
),
places AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM texts WHERE len(w) >= 5)
),
repeated AS (SELECT doc_id, s FROM places GROUP BY doc_id, s HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM places JOIN repeated USING (doc_id, s)) GROUP BY doc_id
),
base AS MATERIALIZED (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines
  FROM texts LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
),
each AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS ratio, {v} AS v, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS bad FROM base WHERE n_words > 0" for k, v in (_VALUES | {quality_rules.LENGTH: "n_words"}).items())}
),
sketch AS MATERIALIZED (
  SELECT lang, source, ratio,
    CASE WHEN v > 0 THEN CAST(floor(ln(v) / ln({quality_rules.GROWTH}) + 1e-9) AS INTEGER) ELSE {quality_rules.ZERO} END AS bucket,
    count(*) AS n
  FROM each WHERE NOT bad AND (v > 0 OR ratio IN ({", ".join(f"'{x}'" for x in quality_rules.SPREAD)})) GROUP BY ALL
),
{_fences("own", "lang, source")}, {_fences("tongue", "lang")}, {_fences("every_one", "")},
outside AS (
  SELECT DISTINCT e.doc_id FROM each e
  JOIN every_one a ON a.ratio = e.ratio
  LEFT JOIN own o ON o.ratio = e.ratio AND o.lang IS NOT DISTINCT FROM e.lang AND o.source IS NOT DISTINCT FROM e.source
  LEFT JOIN tongue t ON t.ratio = e.ratio AND t.lang IS NOT DISTINCT FROM e.lang
  WHERE e.ratio <> '{quality_rules.LENGTH}' AND NOT (CASE WHEN o.n >= {quality_rules.ENOUGH} THEN e.v BETWEEN o.low AND o.high
    WHEN t.n >= {quality_rules.ENOUGH} THEN e.v BETWEEN t.low AND t.high ELSE e.v BETWEEN a.low AND a.high END)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
FROM base
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(k: int, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT doc_id, {k} AS kind, stop - length(hit) AS start, stop, value FROM (
    SELECT doc_id, hit, value, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
      SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(found) AS value,
        unnest(gaps[1 : len(hits)]) AS gap
      FROM (
        SELECT doc_id, regexp_extract_all(body, {_quoted(pattern)}, 0) AS hits,
          regexp_extract_all(body, {_quoted(pattern)}, {group}) AS found,
          regexp_split_to_array(body, {_quoted(pattern)}) AS gaps FROM texts
      )
    )
  ) WHERE length(value) >= {least}"""


_KINDS = "CASE kind " + " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(secret_scan.KINDS)) + " END"
_JOINED = f"string_agg({_KINDS} || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind, stop)"
_LIVE = len(secret_scan.BASE)
OP8 = f"""
WITH texts AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
found AS MATERIALIZED ({" UNION ALL ".join(_spans(k, *rule[1:]) for k, rule in enumerate((*secret_scan.BASE, secret_scan.LIVE)))}),
-- a text counts once, with its first source and its first document
places AS (
  SELECT value, body, min(source) AS owner, min(doc_id) AS repository
  FROM found JOIN texts USING (doc_id) GROUP BY value, body
),
owners AS (
  SELECT value, count(DISTINCT owner) + max(CAST(owner IS NULL AS INTEGER)) >= 3
    OR count(DISTINCT repository) >= 10 AS copied
  FROM places GROUP BY value
),
marked AS MATERIALIZED (
  SELECT doc_id, kind, start, stop, copied,
    NOT copied AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]')
      AND len(list_distinct(string_split(value, ''))) >= {secret_scan.VARIETY}
      AND (kind < {_LIVE} OR regexp_matches(value, '[A-Z]')) AS live
  FROM found JOIN owners USING (value)
),
counts AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (copied) AS n_copied,
    count(*) FILTER (live) AS n_live
  FROM marked GROUP BY doc_id
),
base AS (SELECT doc_id, {_JOINED} AS spans FROM marked WHERE kind < {_LIVE} GROUP BY doc_id),
shown AS (
  SELECT doc_id, {_JOINED} AS spans FROM marked m
  WHERE kind < {_LIVE} OR live AND NOT EXISTS (
    SELECT 1 FROM marked o
    WHERE o.doc_id = m.doc_id AND o.kind < {_LIVE} AND o.start < m.stop AND m.start < o.stop
  )
  GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base.spans, '')) AS base_sha256, coalesce(shown.spans, '') AS spans,
  coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
FROM texts LEFT JOIN counts USING (doc_id) LEFT JOIN base USING (doc_id) LEFT JOIN shown USING (doc_id)
"""


def _rules(column: int) -> str:
    longest = sorted(link_trust.RULES, key=lambda rule: -len(rule[0] + rule[1]))
    value = (lambda r: r[0] + r[1]) if column == 0 else (lambda r: r[2])
    cases = " ".join(
        f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{value(r)}'"
        for r in longest
    )
    return f"CASE {cases} END"


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}')"


_ROUNDS = ",\n".join(
    f"""r{k} AS MATERIALIZED (
  SELECT kind, host, round(s * pow(10.0, {link_trust.DIGITS - 1} - floor(log10(s)))) / pow(10.0, {link_trust.DIGITS - 1} - floor(log10(s))) AS rank
  FROM (SELECT kind, host, sum(rank) AS s FROM (
    SELECT f.kind, f.v AS host, {link_trust.DAMPING} * f.part * r.rank AS rank
    FROM flows f JOIN r{k - 1} r ON r.kind = f.kind AND r.host = f.u
    UNION ALL SELECT kind, host, (1 - {link_trust.DAMPING}) * rank FROM r0
  ) GROUP BY kind, host)
)"""
    for k in range(1, link_trust.ROUNDS + 1)
)
OP10 = rf"""
WITH named AS (
  SELECT page_id, html, {_host("url")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
),
ruled AS MATERIALIZED (SELECT *, {_rules(0)} AS rule, {_rules(1)} AS ruled FROM named),
seeds AS MATERIALIZED (
  SELECT host, count(*) FILTER (ruled = 'allow') AS trusted, count(*) FILTER (ruled = 'block') AS blocked
  FROM ruled WHERE host <> '' GROUP BY host
),
links AS (
  SELECT host AS u, {_host("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END")} AS v FROM (
    SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?((?:[^"''\s>]+:)?//[^"''\s>]+)', 1)) AS link
    FROM ruled
  )
),
parts AS (SELECT string_split(host, '.') AS p FROM seeds),
up AS (
  SELECT DISTINCT array_to_string(p[k : len(p)], '.') AS a, array_to_string(p[k + 1 : len(p)], '.') AS b
  FROM (SELECT p, unnest(range(1, len(p) - 1)) AS k FROM parts WHERE len(p) > 2)
),
edges AS (
  SELECT u, v, sum(w) AS w FROM (
    SELECT u, v, 1.0::DOUBLE AS w FROM links WHERE u <> '' AND v <> '' AND u <> v
    UNION ALL SELECT a, b, {link_trust.DOMAIN_WEIGHT}::DOUBLE FROM up
    UNION ALL SELECT b, a, {link_trust.DOMAIN_WEIGHT}::DOUBLE FROM up
  ) GROUP BY u, v
),
both_ways AS (SELECT 'trust' AS kind, u, v, w FROM edges UNION ALL SELECT 'distrust', v, u, w FROM edges),
flows AS MATERIALIZED (SELECT kind, u, v, w / sum(w) OVER (PARTITION BY kind, u) AS part FROM both_ways),
r0 AS MATERIALIZED (
  SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS rank FROM (
    SELECT 'trust' AS kind, host, trusted::DOUBLE AS n FROM seeds
    UNION ALL SELECT 'distrust', host, blocked::DOUBLE FROM seeds
  ) WHERE n > 0
),
{_ROUNDS},
ranks AS (
  SELECT host, coalesce(max(rank) FILTER (kind = 'trust'), 0) AS trust,
    coalesce(max(rank) FILTER (kind = 'distrust'), 0) AS distrust
  FROM r{link_trust.ROUNDS} GROUP BY host
)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(distrust > {link_trust.MARGIN} * trust, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN ranks USING (host)
"""

OP12 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{NOT_BLANK}+'))::BIGINT AS size,
    CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents
),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, {mixing.MOST}::DOUBLE * source_size AS cap,
    list_extract({list(mixing.WEIGHTS)}, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::DOUBLE AS weight
  FROM sources
),
-- the level if the sources of least cap for their weight stop at it, for any number of them
levels AS (
  SELECT ({mixing.SHARE} * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (
      ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
),
targets AS (SELECT source, source_size, least(weight * (SELECT max(level) FROM levels), cap) AS target FROM weighed),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets
),
placed AS (
  SELECT d.doc_id, d.size, source_size, target, copies, target - copies * source_size::DOUBLE AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, hash) AS here
  FROM d JOIN rests ON d.source IS NOT DISTINCT FROM rests.source
)
SELECT doc_id, size, source_size, target,
  (size * (copies + CASE WHEN upto <= rest OR (upto - here <= rest AND here < 2 * (rest - (upto - here)))
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

OP13 = """
WITH v AS MATERIALIZED (
  SELECT vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""

ORACLE: dict[str, str] = {
    "op1_decontamination": OP1,
    "op3_quality_rules": OP3,
    "op8_secret_scan": OP8,
    "op10_link_trust": OP10,
    "op12_mixing": OP12,
    "op13_hard_negatives": OP13,
}
