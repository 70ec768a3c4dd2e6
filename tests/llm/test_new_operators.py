"""Spelling variants, mixing and hard negatives: odd rows, hot groups and brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslens.llm import hard_negatives, mixing, variants

DOCS = "doc_id long, text string, source string, word string, n long, size long, of string, hash string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t ", "!!! ???", "x", "éÀÿéÀÿé éÀÿéÀÿé", "A b\x00c", "word " * 3000, "長い文章です", "x" * 50_000, "x" * 50_000 + "y"]


def documents(spark, rows):
    """Rows of doc_id, text and source, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*row, "clash", 7, 8, "clash", "clash") for row in rows], DOCS)


# spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b and words[b] >= 10 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], -1)) for w, n in words.items())


def found_variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def misspelt(seed, n):
    draw = random.Random(seed)
    stems = ["".join(draw.choices("abcdeéÿ", k=draw.randint(6, 10))) for _ in range(12)]
    out = []
    for k in range(n):
        word = stems[min(int(draw.expovariate(0.5)), 11)]
        for _ in range(draw.choice((0, 0, 0, 0, 1, 1, 2))):
            at = draw.randrange(len(word))
            word = draw.choice((word[:at] + word[at + 1 :], word[:at] + "b" + word[at:], word[:at] + "d" + word[at + 1 :]))
        out.append(word.upper() if k % 9 == 0 else word)
    return " ".join(out)


@pytest.mark.parametrize("cell", [2, 4096])
def test_variants_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(variants, "CELL", cell)
    rows = [(k, text, "s") for k, text in enumerate(ODD * 2)] + [(None, misspelt(9, 40), None)] * 2
    rows += [(k, misspelt(k, 300), "s") for k in range(100, 112)]
    rows += [(200, "mnopqrst " * 3 + "mnopqrsu " * 60, "s"), *((k, "mnopqrvu " * 100, "s") for k in range(201, 212))]
    expected = brute_variants(rows)
    assert any(r[1] for r in expected) and any(r[1] and r[1] != r[2] for r in expected)
    assert found_variants(variants.grouped(documents(spark, rows).repartition(5))) == expected


def test_every_edit_shares_a_signature(spark):
    draw = random.Random(4)
    words = {"".join(draw.choices("abcé", k=7)) for _ in range(400)}
    counted = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    mine = {(r.word, r.other) for r in variants.near_pairs(counted).collect()}
    assert mine == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_variants_of_nothing(spark):
    assert variants.grouped(documents(spark, [])).collect() == []
    assert variants.grouped(documents(spark, [(1, None, None), (2, "short only", "s")])).collect() == []


# mixing


def expected_targets(sizes):
    """Weights 5, 2, 1 by rank; shares over twice the size go round again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free = {}, dict(sizes)
    left = 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del free[s]
    return target


def mix_rows(seed=3):
    draw = random.Random(seed)
    rows = [(k, text, "é") for k, text in enumerate(ODD)]
    for k in range(100, 1900):
        source = draw.choice(["a", "a", "a", "B", "￿", "\U0001f600", None, "empty"])
        rows.append((k, None if source == "empty" else "w \n" * draw.randint(0, 60), source))
    return rows + [(None, "null id " * 5, "a")] * 3 + [(7, "same row " * 2, "a")] * 2


@pytest.mark.parametrize("step", [2, 12])
def test_mix_comes_near_its_targets(spark, monkeypatch, step):
    monkeypatch.setattr(mixing, "STEP", step)
    rows = mix_rows()
    got = mixing.takes(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, largest = Counter(), Counter()
    for _, text, source in rows:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += words
        largest[source] = max(largest[source], words)
    wanted = expected_targets(sizes)
    by_size = {sizes[s]: s for s in sizes}
    assert len(by_size) == len(sizes)
    taken = Counter()
    for r in got:
        source = by_size[r.source_size]
        assert r.target == pytest.approx(wanted[source])
        assert r.size == 0 or r.taken % r.size == 0 and r.taken <= 2 * r.size
        taken[source] += r.taken
    for source in sizes:
        assert abs(taken[source] - wanted[source]) <= max(largest[source] / 2, 3 * 10)
    assert wanted["é"] == sizes["é"] * 2 or wanted["é"] > 0


def test_mixes_agree_and_are_nested(spark):
    docs = documents(spark, mix_rows(5))
    first = sorted(map(str, mixing.takes(docs).collect()))
    assert sorted(map(str, mixing.takes(docs.repartition(13)).collect())) == first
    small, large = (
        {r.doc_id: r.taken for r in mixing.takes(docs, share=share).collect() if r.doc_id and r.doc_id >= 100}
        for share in (0.6, 0.9)
    )
    assert all(large[k] >= taken for k, taken in small.items()) and sum(large.values()) > sum(small.values())


def test_mixed_documents(spark):
    docs = documents(spark, mix_rows(6))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    wanted = {r.doc_id: r.taken // r.size for r in mixing.takes(docs).collect() if r.size and r.doc_id and r.doc_id >= 100}
    counts = Counter(r.doc_id for r in mix.collect())
    assert all(counts[k] == n for k, n in wanted.items())


def test_mix_of_nothing(spark):
    assert mixing.takes(documents(spark, [])).collect() == []
    assert mixing.mixed(documents(spark, [])).collect() == []
    (row,) = mixing.takes(documents(spark, [(None, None, None)])).collect()
    assert (row.size, row.source_size, row.target, row.taken) == (0, 0, 0.0, 0)


def test_one_hot_source_is_refined_by_more_bits(spark):
    docs = documents(spark, [(k, "a b", "hot") for k in range(3000)] + [(5000, "x", "cold")])
    totals = mixing.takes(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in totals)


# hard negatives

EMB = "vec_id long, embedding array<double>, label int, row long, vector string, rank int"


def embeddings(spark, rows):
    return spark.createDataFrame([(*row, 1, "clash", 2) for row in rows], EMB)


def brute_negatives(rows):
    rows = [
        (i, [int(np.floor(256 * x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for k, (anchor, query, label) in enumerate(rows):
        if anchor % 50:
            continue
        scored = sorted((-sum(map(int.__mul__, query, v)), i, o == label) for j, (i, v, o) in enumerate(rows) if j != k)
        for ps, positive, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(anchor, positive, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, width=6, labels=3, scale=1.0):
    draw = np.random.default_rng(seed)
    return [
        (int(i), [float(x) for x in np.round(draw.normal(0, scale, width), 2)], int(draw.integers(labels))) for i in range(n)
    ]


@pytest.mark.parametrize("block,group,stretch", [(7, 2, 1), (4096, 1024, 8), (64, 3, 4)])
def test_negatives_against_brute_force(spark, monkeypatch, block, group, stretch):
    for name, value in (("BLOCK", block), ("GROUP", group), ("STRETCH", stretch)):
        monkeypatch.setattr(hard_negatives, name, value)
    nan, inf = float("nan"), float("inf")
    rows = vectors(1, 260) + [(50, [9.0] * 6, 1), (50, [9.0] * 6, 1), (51, [9.0] * 6, 1), (300, [0.0] * 6, 2), (350, [], 0)]
    rows += [(400, [1.5, 2.5], 0), (401, [0.5], 1), (450, [1.0] * 9, 2)]
    rows += [(None, [1.0] * 6, 1), (500, None, 1), (501, [1.0] * 6, None), (550, [None, 1.0], 1), (600, [nan], 1), (601, [inf], 1)]
    expected = brute_negatives(rows)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = sorted(tuple(r[n] for n in names) for r in hard_negatives.mined(embeddings(spark, rows)).collect())
    assert expected and got == expected


def test_negatives_with_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    rows = vectors(2, 150) + [(i, [0.5] * 6, 1) for i in range(200, 320)] + [(i, [0.45] * 6, 2) for i in range(320, 400)]
    got = hard_negatives.mined(embeddings(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows)


def test_negatives_beyond_doubles(spark):
    rows = [(i, v, label) for i, v, label in vectors(3, 120, scale=4e5)]
    assert sorted(map(tuple, hard_negatives.mined(embeddings(spark, rows)).collect())) == brute_negatives(rows)


def test_negatives_of_nothing(spark):
    assert hard_negatives.mined(embeddings(spark, [])).collect() == []
    assert hard_negatives.mined(embeddings(spark, [(50, [1.0], 1), (51, [1.0], 2)])).collect() == []


def test_bitmap_shrinks_before_the_last_dimension():
    draw = np.random.default_rng(5)
    columns = np.round(draw.normal(0, 3, (64, 500))).astype(np.int64)
    columns[:4] *= 40
    block, anchors = (hard_negatives.Columns.__new__(hard_negatives.Columns) for _ in range(2))
    block.columns, anchors.columns = columns, columns[:, :1]
    seen = []

    def cut(lower, upper, rows):
        seen.append(len(rows))
        exact = columns[:, 0] @ columns[:, rows]
        assert (lower <= exact).all() and (exact <= upper).all()
        return upper >= np.partition(lower, -5)[-5]

    hard_negatives.Scan(block, anchors).run(0, np.arange(500), cut)
    assert seen[0] == 500 and seen[1] < 250
