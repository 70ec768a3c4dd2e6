"""Benchmark decontamination with suffix arrays over the training texts.

The training texts are cut into shards of about a million words. Each shard gets a suffix array
over its word sequence, and the suffixes of the benchmark items are searched in it by bisection,
all at once. Shards are made within a task and hold whole texts (a longer text is cut into
overlapping stretches), so nothing is shuffled and a lost task is simply run again.

The windows that occur are then followed further: a text's longest verbatim match begins where a
window does, and its length is bisected over hashes of whole stretches, for all texts at once.

Words and stretches are compared by 64-bit hashes; two different ones agree with a chance of about 5e-20.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.bytewise import ITEM_WORD, LOWER, blocks, hashes, words
from saleslens.llm.common import stored

SHARD_BYTES = 3 << 20
STRETCH_WORDS = 1 << 20
#: Benchmark words that are sent to the executors at once, 8 bytes each (one item at least).
BLOCK_WORDS = 1 << 20


class Suffixes:
    """Suffixes of benchmark items that hold a whole window, and the distinct windows among them."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        items = [(name, found) for name, found in items if len(found)]
        self.names = [name for name, _ in items]
        self.flat = np.concatenate([found for _, found in items] or [np.zeros(0, np.uint64)])
        size = np.array([len(found) for _, found in items], dtype=np.int64)
        first = np.cumsum(size) - size
        width = np.minimum(size, window)
        count = size - width + 1
        self.item = np.repeat(np.arange(len(items)), count)
        self.start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.at = self.start + first[self.item]
        self.width = width[self.item]
        self.length = size[self.item] - self.start
        self.depth = int(size.max()) if len(size) else 0


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of seq (numbers from 0) in the order of their suffixes, as far as `depth` numbers."""
    n = len(seq)
    bits = max(int(max(seq.max(initial=0), n)).bit_length(), 1)
    per = max(62 // bits, 2)

    def keys(rank: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        key = rank[at]
        for j in range(1, per):
            place = at + j * step
            key = (key << bits) | np.where(place < n, rank[np.minimum(place, n - 1)], 0)
        return key

    rank = seq.astype(np.int64)
    slots = np.arange(n)
    order = np.arange(n)
    step = 1
    while True:
        members = order[slots]
        key = keys(rank, members, step)
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[slots] = members
        step *= per
        new = np.r_[True, key[1:] != key[:-1]]
        if step >= depth or new.all():
            return order
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(key)])
        fresh = rank if step > per else np.empty(n, dtype=np.int64)
        fresh[members] = np.repeat(slots[begin], size) + 1
        rank = fresh
        slots = slots[np.repeat(size > 1, size)]


def bisect(seq: np.ndarray, order: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """For each row of `wanted`, the first suffix that is not before it (or is after all its equals)."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    reach = np.arange(wanted.shape[1])
    rows = np.arange(len(wanted))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        gap = seq[order[np.minimum(middle, len(order) - 1)][:, None] + reach] - wanted
        differs = gap[rows, (gap != 0).argmax(axis=1)]
        right = open_ & ((differs <= 0) if after else (differs < 0))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


class Stretches:
    """Hashes of any stretch of a sequence of 64-bit numbers, from running sums."""

    def __init__(self, values: np.ndarray):
        powers = np.cumprod(np.full(len(values) + 1, _FACTOR), dtype=np.uint64)
        self.back = np.cumprod(np.full(len(values) + 1, _UNDO), dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(values * powers[:-1], dtype=np.uint64)]

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(int(_FACTOR), -1, 1 << 64))


def reach(
    mine: Stretches, at: np.ndarray, room: np.ndarray, group: np.ndarray,
    theirs: Stretches, place: np.ndarray, extent: np.ndarray, least: np.ndarray, most: np.ndarray,
) -> np.ndarray:
    """For each group the greatest length, from `least` (which one has) to `most`, at which one of its
    stretches equals one of theirs. They begin `at` and in `place` and have `room` and `extent`."""
    low, high = least.copy(), np.maximum(least, most)
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        fits = np.zeros(len(low), dtype=bool)
        want = middle[group]
        rows = np.flatnonzero(open_[group] & (room >= want))
        rows = rows[np.argsort(want[rows], kind="stable")]
        for these in np.split(rows, np.flatnonzero(np.diff(want[rows])) + 1):
            if len(these):
                size = int(want[these[0]])
                same = np.isin(mine(at[these], size), theirs(place[extent >= size], size))
                fits[group[these[same]]] = True
        low = np.where(open_ & fits, middle, low)
        high = np.where(open_ & ~fits, middle - 1, high)
    return low


class Shard:
    """Suffix array over word hashes of texts; text numbers ascend."""

    def __init__(self, found: np.ndarray, text: np.ndarray, suffixes: Suffixes):
        self.known, number = np.unique(found, return_inverse=True)
        self.found, self.text = found, text
        ordinal = np.cumsum(np.r_[0, np.diff(text) != 0]) if len(text) else text
        self.place = np.arange(len(found)) + ordinal
        length = len(found) + (int(ordinal[-1]) + 1 if len(text) else 0)
        seq = np.zeros(length, dtype=np.int64)
        seq[self.place] = number + 1
        self.word = np.full(length, -1, dtype=np.int64)
        self.word[self.place] = np.arange(len(found))
        self.order = suffix_array(seq, suffixes.depth)
        self.seq = np.r_[seq, np.full(suffixes.depth + 1, -1)]
        slot = np.minimum(np.searchsorted(self.known, suffixes.flat), len(self.known) - 1)
        self.wanted = np.where(self.known[slot] == suffixes.flat, slot + 1, -2)
        missing = np.r_[0, np.cumsum(self.wanted == -2)]
        self.suffixes = suffixes
        self.live = np.flatnonzero(
            missing[suffixes.at + suffixes.width] == missing[suffixes.at]
        )

    def ranges(self) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(suffixes, width, from, to): where in the suffix array their windows stand."""
        s = self.suffixes
        for width in np.unique(s.width[self.live]):
            these = self.live[s.width[self.live] == width]
            rows = self.wanted[s.at[these][:, None] + np.arange(width)]
            distinct, back = np.unique(rows, axis=0, return_inverse=True)
            low = bisect(self.seq, self.order, distinct, False)[back.ravel()]
            high = bisect(self.seq, self.order, distinct, True)[back.ravel()]
            hit = high > low
            if hit.any():
                yield these[hit], int(width), low[hit], high[hit]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words hit, by word; pairs of a text and an item with a window in it, once a window; places
        of the full windows in the sequence; and (text, width, word) of the first of its widest windows.

        The occurrences of a window are counted by text before they meet its items, so that a
        frequent window of many items gives no more pairs than texts and items have in common.
        """
        s, edge = self.suffixes, np.zeros(len(self.seq) + 1, dtype=np.int64)
        owners, full, widest = [np.zeros((2, 0), np.int64)], np.zeros(0, np.int64), [np.zeros((3, 0), np.int64)]
        for these, width, low, high in self.ranges():
            windows, one = np.unique(low, return_index=True)
            count = (high - low)[one]
            first = np.cumsum(count) - count
            at = self.order[np.arange(int(count.sum())) + np.repeat(windows - first, count)]
            edge += np.bincount(at, minlength=len(edge))
            edge -= np.bincount(at + width, minlength=len(edge))
            place = np.sort(at)
            text, one = np.unique(self.text[self.word[place]], return_index=True)
            widest.append(np.stack([text, np.full(len(text), width), self.word[place[one]]]))
            if width == s.window:
                full = place
            inside = np.stack([np.repeat(np.arange(len(windows)), count), self.text[self.word[at]]])
            window, text = np.unique(inside, axis=1)
            item = np.unique(np.stack([low, s.item[these]]), axis=1)
            group = np.searchsorted(windows, item[0])
            bounds = np.searchsorted(window, np.arange(len(windows) + 1))
            size = np.diff(bounds)[group]
            spread = np.arange(int(size.sum())) + np.repeat(bounds[group] - (np.cumsum(size) - size), size)
            owners.append(np.stack([text[spread], np.repeat(item[1], size)]))
        first = np.concatenate(widest, axis=1)
        first = first[:, np.lexsort((-first[1], first[0]))]
        first = first[:, np.r_[True, np.diff(first[0]) > 0]] if first.size else first
        return np.cumsum(edge)[self.place] > 0, np.concatenate(owners, axis=1), full, first

    def _sums(self) -> tuple[Stretches, Stretches]:
        """Of the shard, where no word of an item stands between texts, and of the items."""
        values = np.full(len(self.word), _FACTOR)
        values[self.place] = self.found
        return Stretches(values), Stretches(self.suffixes.flat)

    def longest(self, full: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(text, length, word) of the longest match of each text with a window, the first of equal ones."""
        s, out = self.suffixes, first.copy()
        wide = np.flatnonzero(out[1] == s.window)
        if not len(wide):
            return out
        mine, theirs = self._sums()
        live = self.live[s.width[self.live] == s.window]
        group = np.searchsorted(out[0, wide], self.text[self.word[full]])
        room = len(self.word) - full
        out[1, wide] = length = reach(
            mine, full, room, group, theirs, s.at[live], s.length[live],
            out[1, wide], np.full(len(wide), s.length[live].max()),
        )
        longer = np.flatnonzero(length[group] > s.window)
        longer = longer[np.argsort(length[group[longer]], kind="stable")]
        for these in np.split(longer, np.flatnonzero(np.diff(length[group[longer]])) + 1):
            if len(these):
                size = int(length[group[these[0]]])
                these = these[room[these] >= size]
                these = these[np.isin(mine(full[these], size), theirs(s.at[live[s.length[live] >= size]], size))]
                texts, one = np.unique(group[these], return_index=True)
                out[2, wide[texts]] = self.word[full[these[one]]]
        return out

    def longest_of_suffixes(self) -> Iterator[tuple[int, int, int]]:
        """(suffix, word, length) of the longest match of each suffix whose window occurs, the first of equal ones."""
        s, sums = self.suffixes, None
        for these, width, low, high in self.ranges():
            windows, one = np.unique(low, return_index=True)
            count = (high - low)[one]
            at = self.order[np.arange(int(count.sum())) + np.repeat(windows - (np.cumsum(count) - count), count)]
            at = np.sort(at)
            sums = sums or self._sums()
            room, least = len(self.word) - at, np.full(len(these), width)
            length = reach(
                sums[1], s.at[these], s.length[these], np.arange(len(these)), sums[0], at, room, least, s.length[these]
            )
            for size in np.unique(length).tolist():
                mine, fits = np.flatnonzero(length == size), at[room >= size]
                there, first = np.unique(sums[0](fits, size), return_index=True)
                found = fits[first[np.searchsorted(there, sums[1](s.at[these[mine]], size))]]
                yield from zip(these[mine].tolist(), self.word[found].tolist(), [size] * len(mine))


def _read(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, row of each word) of shards of whole texts."""
    for row, end, data, offsets in blocks(texts, SHARD_BYTES):
        data = LOWER[data]
        start, stop, text = words(data, offsets, ITEM_WORD)
        yield row, end, hashes(data, start, stop), text


def _stretches(found: np.ndarray, text: np.ndarray, suffixes: Suffixes) -> Iterator[tuple[int, Shard]]:
    """(first word, shard); neighbours overlap by the longest item, so that no match is cut."""
    for at in range(0, max(len(found), 1), STRETCH_WORDS):
        to = at + STRETCH_WORDS + suffixes.depth
        if len(found[at:to]):
            yield at, Shard(found[at:to], text[at:to], suffixes)


def _hit_rows(texts: pa.Array, suffixes: Suffixes) -> tuple[list, list, list, list]:
    """For each text: number of words, [from, to, from, to, ...] of its hit words, items, [length, from]
    of its longest match (or nothing)."""
    n_words, spans, items, longest = [], [], [], []
    for row, end, found, text in _read(texts):
        n_words += np.bincount(text, minlength=end - row).tolist()
        covered, pairs = np.zeros(len(found), bool), [np.zeros((2, 0), np.int64)]
        best: dict[int, list[int]] = {}
        if suffixes.names:
            for at, shard in _stretches(found, text, suffixes):
                hit, owned, full, widest = shard.hits()
                covered[at : at + len(hit)] |= hit
                pairs.append(np.unique(owned, axis=1))
                for k, length, word in shard.longest(full, widest).T.tolist():
                    best[k] = longer(best.get(k, []), [length, word + at])
        first = np.searchsorted(text, np.arange(end - row + 1))
        edge = covered.copy()
        edge[1:] = covered[1:] & (~covered[:-1] | (text[1:] != text[:-1]))
        stop = covered.copy()
        stop[:-1] = covered[:-1] & (~covered[1:] | (text[1:] != text[:-1]))
        span = np.stack([np.flatnonzero(edge), np.flatnonzero(stop) + 1], axis=1)
        owner = np.unique(np.concatenate(pairs, axis=1), axis=1)
        mine, theirs = (np.split(x, np.searchsorted(by, np.arange(1, end - row)))
                        for x, by in ((span, text[span[:, 0]]), (owner[1], owner[0])))
        for k, (a, b) in enumerate(zip(mine, theirs, strict=True)):
            spans.append((a - first[k]).ravel().tolist())
            items.append([suffixes.names[i] for i in b])
            longest.append([best[k][0], best[k][1] - int(first[k])] if k in best else [])
    return n_words, spans, items, longest


def longer(a: list[int], b: list[int]) -> list[int]:
    """Of two matches [length, from] the longer one, of equal ones the first; either may be missing."""
    return max(a, b, key=lambda x: (x[0], -x[1]) if x else (0, 0))


FOUND = T.StructField(
    "found",
    T.StructType()
    .add("n_words", T.LongType())
    .add("spans", T.ArrayType(T.LongType()))
    .add("items", T.ArrayType(T.StringType()))
    .add("longest", T.ArrayType(T.LongType())),
)


def benchmark_blocks(
    benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int
) -> Iterator[Suffixes]:
    """The benchmark item by item, in blocks of bounded size; always one block at least."""
    rows, size, sent = [], 0, False
    chosen = benchmark.select(F.col(item_id).cast("string"), F.coalesce(text, F.lit("")))
    for name, body in chosen.toLocalIterator():
        for _, _, found, _ in _read(pa.array([body], pa.large_string())):
            rows.append((name, found))
            size += len(found)
        if size >= block_words:
            yield Suffixes(rows, window)
            rows, size, sent = [], 0, True
    if rows or not sent:
        yield Suffixes(rows, window)


def scan(
    docs: DataFrame, benchmark: DataFrame, kept: Column, window: int = 10, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
    inside: bool = False,
) -> DataFrame:
    """One row per document: `kept` (any column of docs, as a struct) and `found`.

    found.n_words counts its words, found.spans holds [from, to, from, to, ...] of the words inside
    an occurrence of a benchmark window, found.items the items with such a window, found.longest
    [length, from] of the longest verbatim match with an item that holds a window. A null text has
    no words, an empty benchmark hits nothing, items without words are passed over, equal items both
    count. The windows of an item without an id count as any, its name is null. A benchmark over `block_words` words is searched block by block,
    each pass adding to what the pass before has found. `inside` says that `kept` holds the text too,
    as a field of that name, so that it travels once.
    """
    spark = docs.sparkSession
    body = [] if inside else [F.coalesce(F.col(text), F.lit("")).alias("body")]
    out = docs.select(kept.alias("kept"), *body)
    every = benchmark_blocks(benchmark, item_id, item_text, window, block_words)
    suffixes = next(every)
    while suffixes is not None:
        following = next(every, None)
        shape = T.StructType([out.schema["kept"], FOUND])
        if following is not None and not inside:
            shape = shape.add(out.schema["body"])
        run = _pass(spark.sparkContext.broadcast(suffixes), shape.names, text if inside else None)
        out = out.mapInArrow(run, shape)
        if following is not None:
            out = stored(out)
        suffixes = following
    return out


def _pass(sent, names: list[str], field: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = sent.value
        for batch in batches:
            if field is None:
                body = batch.column("body")
            else:
                body = pc.fill_null(batch.column("kept").field(field), "")
            n_words, spans, items, longest = _hit_rows(body, suffixes)
            if "found" in batch.schema.names:
                old = batch.column("found").to_pylist()
                spans = [union(a["spans"], b) for a, b in zip(old, spans, strict=True)]
                items = [a["items"] + b for a, b in zip(old, items, strict=True)]
                longest = [longer(a["longest"], b) for a, b in zip(old, longest, strict=True)]
            found = pa.StructArray.from_arrays(
                [
                    pa.array(n_words, pa.int64()),
                    pa.array(spans, pa.list_(pa.int64())),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(longest, pa.list_(pa.int64())),
                ],
                ["n_words", "spans", "items", "longest"],
            )
            columns = {"kept": batch.column("kept"), "found": found, "body": body}
            yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)

    return run


def union(a: list[int], b: list[int]) -> list[int]:
    """Both sets of stretches [from, to, ...] as one, merged."""
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def n_hit(found: Column) -> Column:
    """Number of words in the stretches."""
    signed = F.transform(found["spans"], lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast(T.LongType()), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; longest_match, the words
    of its longest verbatim match with an item that holds a window (0 if none), and longest_at, the
    words before the first such match (null if none)."""
    out = scan(docs, benchmark, F.struct("doc_id"), window)
    items = F.array_sort(F.array_distinct(F.array_compact(F.col("found.items"))))
    return out.select(
        F.col("kept.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        n_hit(F.col("found")).alias("n_hit"),
        F.size(items).cast(T.LongType()).alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
        F.coalesce(F.get("found.longest", F.lit(0)), F.lit(0)).cast(T.LongType()).alias("longest_match"),
        F.get("found.longest", F.lit(1)).alias("longest_at"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    out = scan(docs, benchmark, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), window, inside=True)
    return out.filter(F.size("found.spans") == 0).select("kept.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per suffix of an item that begins with an occurring window, its longest verbatim match.

    item_id, item_start, length, doc_id, doc_start; places in words. Of equal lengths the smallest
    doc_id and place count.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).filter("doc_id is not null")
    parts = []
    for suffixes in benchmark_blocks(benchmark, "item_id", "text", window, BLOCK_WORDS):
        sent = spark.sparkContext.broadcast(suffixes)
        parts.append(rows.mapInArrow(
            _matches(sent), "item_id string, item_start long, length long, doc_id long, doc_start long"
        ))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("d"), (-F.col("doc_start")).alias("s")))
    return every.groupBy("item_id", "item_start").agg(best.alias("m")).select(
        "item_id", "item_start", F.col("m.length").alias("length"),
        (-F.col("m.d")).alias("doc_id"), (-F.col("m.s")).alias("doc_start"),
    )


def _matches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = sent.value
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for row, _, found, text in _read(batch.column("body")):
                for at, shard in _stretches(found, text, suffixes):
                    for q, word, length in shard.longest_of_suffixes():
                        mine = text[word + at]
                        out.append((
                            suffixes.names[suffixes.item[q]], int(suffixes.start[q]), length,
                            ids[row + int(mine)].as_py(), word + at - int(np.searchsorted(text, mine)),
                        ))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["item_id", "item_start", "length", "doc_id", "doc_start"],
            )

    return run
