"""Vectorised work on the UTF-8 bytes of many texts at once.

A block is one array of bytes, the texts after one another, and `offsets`, where each begins and
the last ends. A word never spans two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    chosen = np.zeros(256, dtype=bool)
    for first, last in ranges:
        chosen[first : last + 1] = True
    return chosen


def lower_table() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return lower


#: Bytes of the words of decontamination, which are digits, a-z and all beyond ASCII.
ITEM_WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NOT_BLANK = ~byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = lower_table()


def blocks(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of blocks of about `limit` bytes, or one text."""
    if len(texts) == 0:
        return
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, where, data = texts.buffers()
    where = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(where, where[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, data[where[row] : where[end]], where[row : end + 1] - where[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and text number of every maximal run of bytes of a kind."""
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: a polynomial of its bytes, mixed with its length."""
    global _powers
    if len(start) == 0:
        return np.zeros(0, dtype=np.uint64)
    size = (end - start).astype(np.int64)
    longest = int(size.max())
    if longest > len(_powers):
        _powers = np.cumprod(np.full(max(longest, 64), _BASE), dtype=np.uint64)
    begins = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begins, size)
    value = data[place + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)
    return mixed(np.add.reduceat(value * _powers[place], begins) + size.astype(np.uint64))
