"""Vectorised word tables over Arrow string columns.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and carriage return. All words
of a slice of documents are hashed at once: with prefix sums of ``byte * base**position`` modulo 2**64, the hash of any
span is a difference times an inverse power, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


@dataclass
class Slice:
    """Documents ``first .. first + rows`` of a batch: their bytes end to end, and where each begins."""

    first: int
    rows: int
    data: np.ndarray  # uint8
    bounds: np.ndarray  # int64, rows + 1
    valid: np.ndarray  # bool

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many marked bytes each document has."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


@dataclass
class Words:
    start: np.ndarray  # int64 byte positions within the slice
    end: np.ndarray
    row: np.ndarray  # document of each word, ascending
    bounds: np.ndarray  # int64, rows + 1: words of each document


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``limit`` bytes; nulls count as empty and are marked."""
    column = column.cast(pa.large_string())
    valid = np.asarray(column.is_valid())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(len(column), max(to, at + 1))
        yield Slice(at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], valid[at:to])
        at = to


def spans(inside: np.ndarray, bounds: np.ndarray) -> Words:
    """Maximal runs of ``inside`` that don't cross a document's bounds."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(bounds), np.int64))
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    cuts = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(cuts))
    return Words(start, end, row, cuts)


def words(part: Slice) -> Words:
    return spans(~_SPACE[part.data], part.bounds)


def lower(part: Slice) -> np.ndarray:
    """The bytes with A-Z lower-cased and nothing else changed."""
    return _LOWER[part.data]


class SpanHasher:
    """64-bit hashes of spans of ``data``; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self._total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=self._total[1:])
        self._back = _power(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._total[end] - self._total[start]) * self._back[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))


class RunHasher:
    """64-bit hashes of runs of 64-bit ``values``; equal runs have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self._total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(values) * _power(_BASE, n), out=self._total[1:])
        self._back = _power(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._total[end] - self._total[start]) * self._back[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return SpanHasher(data)(start, end)


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a document, and their bounds; ``short``: a document with fewer words
    gives its whole sequence as one window."""
    n = len(hashes)
    acc = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    for i in range(width):
        acc = acc * np.uint64(0xF1357AEA2E62A9C5) + hashes[i : n - width + 1 + i] if n >= width else acc
    acc = mix(acc)
    counts = np.diff(bounds)
    full = np.maximum(counts - width + 1, 0)
    first = np.repeat(bounds[:-1], full)
    begin = np.concatenate(([0], np.cumsum(full)))
    inside = np.arange(begin[-1]) - np.repeat(begin[:-1], full)
    out = acc[first + inside]
    if not short:
        return out, begin
    few = np.flatnonzero((counts > 0) & (counts < width))
    if not len(few):
        return out, begin
    own = np.zeros(len(few), dtype=np.uint64)
    for k in range(width - 1):
        has = counts[few] > k
        own[has] = own[has] * np.uint64(0xF1357AEA2E62A9C5) + hashes[bounds[few[has]] + k]
    own = mix(own ^ (counts[few].astype(np.uint64) << np.uint64(56)))
    return np.insert(out, begin[few], own), np.concatenate(([0], np.cumsum(full + ((counts > 0) & (counts < width)))))


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document in ascending order, and their bounds."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(bounds)))
