"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

A document is cut into whole windows and a rest; the rests are gathered in batches and each batch
is divided by differencing: of the partial partitions, the two with the largest spread are merged,
the fullest windows of one with the emptiest of the other, until one partition is left. Its windows
are nearly equal; if one exceeds the capacity, the batch gets one window more.

Every task packs the documents it reads, so nothing is shuffled, and a lost task makes the same
windows again.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 1024
#: Windows that a batch of rests should fill, and how full on average.
WINDOWS = 48
FILL = 0.993
#: Rests are cut to this many tokens at most, since windows of few large parts can't be made equal.
LARGEST = 256
#: End of document, and the name of the vocabulary among the public tokenizers,
#: which has a file of ranks (.tiktoken) and one of the whole tokenizer (.json).
END = 0
VOCABULARY = "byte_bpe_50k"


def encoder(name: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizer's own file gives them; its added tokens are found in texts too.

    The ranks encode faster, but their splitting pattern gives up on runs of very many blanks. Such
    a text is encoded by the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    whole = Tokenizer.from_file(str(public_tokenizers.path(f"{name}.json")))
    added = {token.content: number for number, token in whole.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items of each of at most `windows` windows, whose sums are nearly equal."""
    heap = [(-size, i, [size], [(i,)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        alone = max(windows - len(b), 0)
        met = max(len(a) - alone, 0)
        rest = len(b) - met
        pairs = [*zip(a[:alone], own), *zip(b[:rest], other)]
        pairs += [
            (x + y, (p, q)) for x, p, y, q in zip(a[alone:], own[alone:], b[::-1], other[::-1])
        ]
        pairs.sort(key=lambda pair: -pair[0])
        sums, parts = [p[0] for p in pairs], [p[1] for p in pairs]
        low = sums[-1] if len(sums) == windows else 0
        heapq.heappush(heap, (low - sums[0], tie, sums, parts))
        tie += 1
    return [_flat(part) for part in heap[0][3]] if heap else []


def _flat(part: tuple) -> list[int]:
    """Leaves of a tree of pairs, without recursion."""
    out, left = [], [part]
    while left:
        node = left.pop()
        if isinstance(node, tuple):
            left.extend(node)
        else:
            out.append(node)
    return out


def divided(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within the capacity, as few as differencing finds, counted up one by one."""
    windows = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, windows)
        if all(sum(sizes[i] for i in window) <= capacity for window in found):
            return found
        windows += 1


class Packer:
    """Turns rests (document, start, length) into pieces (document, start, window, offset)."""

    def __init__(self, capacity: int = CAPACITY, windows: int = WINDOWS, fill: float = FILL, largest: int = LARGEST):
        self.capacity, self.largest, self.fill = capacity, largest, fill
        self.target = int(windows * capacity * fill)
        self.rests: list[tuple] = []
        self.total = 0
        self.made = 0

    def add(self, document, start: int, length: int) -> Iterator[tuple]:
        """Pieces (document, start, length, window, offset) that are settled by these tokens."""
        end = start + length
        while end - start >= self.capacity:
            yield document, start, self.capacity, self._new(), 0
            start += self.capacity
        parts = -(-(end - start) // self.largest)
        for k in range(parts):
            size = (end - start) // (parts - k)
            if self.total + size > self.target:
                room = self.target - self.total
                if room:
                    self.rests.append((document, start, room))
                    self.total += room
                yield from self.flush()
                start, size = start + room, size - room
            if size:
                self.rests.append((document, start, size))
                self.total += size
                start += size

    def finish(self) -> Iterator[tuple]:
        """Pieces of all that is left. What doesn't fill a window goes to sequences whose lengths
        are powers of two, which need no padding."""
        surplus = self.total - int(self.total // self.capacity * self.capacity * self.fill)
        while surplus:
            length = min(1 << surplus.bit_length() - 1, self.capacity)
            surplus -= length
            number, offset = self._new(), 0
            while offset < length:
                document, start, size = self.rests.pop()
                taken = min(size, length - offset)
                yield document, start + size - taken, taken, number, offset
                offset += taken
                self.total -= taken
                if taken < size:
                    self.rests.append((document, start, size - taken))
        yield from self.flush()

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def flush(self) -> Iterator[tuple]:
        sizes = [length for _, _, length in self.rests]
        for window in divided(sizes, self.capacity):
            number, offset = self._new(), 0
            for document, start, length in sorted(self.rests[i] for i in window):
                yield document, start, length, number, offset
                offset += length
        self.rests, self.total = [], 0


PIECE = (
    T.StructType()
    .add("start", T.LongType())
    .add("length", T.LongType())
    .add("ids_crc32", T.LongType())
    .add("doc_tokens", T.LongType())
    .add("sequence_id", T.LongType())
    .add("offset", T.LongType())
    .add("ids", T.ArrayType(T.IntegerType()))
)
#: Pieces of an output batch.
BATCH = 4096


def _packed(vocabulary: str, with_ids: bool, names: list[str]):
    """A document's ids are kept until its last piece is settled: bounded by the batch in hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary), Packer()
        first = TaskContext.get().partitionId() << 33
        rows: dict[int, tuple] = {}
        out: dict[str, list] = {name: [] for name in ["kept", *PIECE.names]}
        seen = 0

        def settle(pieces: Iterator[tuple]) -> None:
            for document, start, length, window, offset in pieces:
                kept, ids, left = rows[document]
                own = ids[start : start + length]
                out["kept"].append(kept)
                values = (start, length, zlib.crc32(own), len(ids), first + window, offset, own if with_ids else None)
                for name, value in zip(PIECE.names, values, strict=True):
                    out[name].append(value)
                if left == length:
                    del rows[document]
                else:
                    rows[document] = (kept, ids, left - length)

        def emitted() -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())]
            columns = [pa.concat_arrays(out["kept"])] if out["kept"] else []
            columns += [pa.array(out[name], kind) for name, kind in zip(PIECE.names, kinds, strict=True)]
            found = dict(zip(["kept", *PIECE.names], columns, strict=True))
            for values in out.values():
                values.clear()
            return pa.RecordBatch.from_arrays([found[name] for name in names], names)

        for batch in batches:
            kept = batch.column("kept")
            for row, text in enumerate(batch.column("body")):
                ids = np.append(encode(text.as_py()), np.uint32(END)).astype("<u4")
                rows[seen] = (kept.slice(row, 1), ids, len(ids))
                settle(packer.add(seen, 0, len(ids)))
                seen += 1
                if len(out["kept"]) >= BATCH:
                    yield emitted()
        settle(packer.finish())
        if out["kept"]:
            yield emitted()

    return run


def pack(
    docs: DataFrame, kept: Column, text: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = False
) -> DataFrame:
    """One row per piece: `kept` (any column of docs), start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty and has the end token alone; equal rows are packed each for itself.
    sequence_id is unique over the whole result, offset runs without gaps in each sequence, and
    the tokens of a document may lie in several. with_ids adds the ids themselves.
    """
    rows = docs.select(kept.alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    names = [name for name in PIECE.names if with_ids or name != "ids"]
    shape = T.StructType([rows.schema["kept"], *(PIECE[name] for name in names)])
    return rows.mapInArrow(_packed(vocabulary, with_ids, shape.names), shape)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of all pieces."""
    return pack(docs, F.col("doc_id")).withColumnRenamed("kept", "doc_id")
