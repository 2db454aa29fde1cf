"""Vectorised word work on Arrow string columns, straight on their UTF-8 bytes.

Words are ``[^\\x20\\x09-\\x0D]+``. Every function looks at whole texts. A word's
hash is a 64-bit polynomial over its bytes with an odd base (so it comes from two
prefix sums), finished with a bit mixer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


class Words(NamedTuple):
    """Words of a column: ``buf`` the bytes, ``first`` the index of each text's first word (one more at the end)."""

    buf: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            t = np.full(size, np.uint64(base), dtype=np.uint64)
            t[0] = 1
            globals()[name] = np.cumprod(t, dtype=np.uint64)
    return _powers[:n], _inverses[:n]


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and each text's bounds in them; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(bounds), np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def parts(col: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) slices of at most ``max_bytes`` of text; a longer text is a slice of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, bounds = byte_view(col)
    at, n = 0, len(col)
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + max_bytes, side="right")) - 1)
        yield at, col.slice(at, to - at)
        at = to


def words_of(col: pa.Array, lower: bool = False) -> Words:
    buf, bounds = byte_view(col)
    if lower:
        buf = _LOWER[buf]
    return spans_of(buf, bounds, ~_SPACE[buf])


def spans_of(buf: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes that are ``inside``; none crosses from one text to the next."""
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(len(buf), dtype=bool)
    if len(buf):
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), dtype=bool)
    if len(buf):
        after[-1] = False
        after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(buf, bounds, start, end, np.searchsorted(start, bounds, side="left"))


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def latin_runs_of(col: pa.Array) -> Words:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased. The latter are the byte C3 and one more."""
    buf, bounds = byte_view(col)
    buf = _LOWER[buf]
    inside = _LETTER[buf]
    inside[1:] |= buf[:-1] == 0xC3
    return spans_of(buf, bounds, inside)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_parts(col: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Like ``parts``, but a text of over ``max_bytes`` comes in several one-row arrays, cut at blanks: no word is
    cut, and memory follows ``max_bytes`` (or the longest word) instead of the longest text."""
    for at, some in parts(col, max_bytes):
        buf, bounds = byte_view(some)
        if len(some) > 1 or bounds[-1] <= max_bytes:
            yield at, some
            continue
        whole, start = memoryview(buf), 0
        while start < len(whole):
            blank = _BLANK.search(whole, start + max_bytes) if start + max_bytes < len(whole) else None
            end = blank.end() if blank else len(whole)
            yield at, pa.array([bytes(whole[start:end])], pa.binary())
            start = end


def span_strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column."""
    size = (end - start).astype(np.int64)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    data = buf[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])] if len(size) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


_FIELD = 40  # bits of one count


def packed(*counts: np.ndarray) -> list[int]:
    """Several counts of each word as one number; each below 2**23."""
    return sum(c.astype(np.int64) << (_FIELD * k) for k, c in enumerate(counts)).tolist()


class WordCounts:
    """``width`` counts by word that a task gathers before it hands them on, until ``full``."""

    def __init__(self, width: int, max_words: int = 200_000, max_bytes: int = 1 << 24) -> None:
        self.held: dict[str, int] = {}
        self.width, self.max_words, self.max_bytes, self.long_bytes = width, max_words, max_bytes, 0

    def add(self, words: list[str], counts: list[int]) -> None:
        """``counts``: as by ``packed``."""
        held, get = self.held, self.held.get
        for word, more in zip(words, counts):
            held[word] = get(word, 0) + more
        self.long_bytes += sum(n for n in map(len, words) if n > 64)

    @property
    def full(self) -> bool:
        return len(self.held) >= self.max_words or self.long_bytes >= self.max_bytes

    def taken(self, names: list[str]) -> pa.RecordBatch:
        """All of them as one batch (word, counts...); nothing is held after that."""
        sums, mask = list(self.held.values()), (1 << _FIELD) - 1
        columns = [pa.array([(x >> (_FIELD * k)) & mask for x in sums], pa.int64()) for k in range(self.width)]
        batch = pa.RecordBatch.from_arrays([pa.array(list(self.held), pa.string()), *columns], names=names)
        self.held, self.long_bytes = {}, 0
        return batch
