"""Words of whole Arrow batches, found and hashed in numpy on the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are worked on at a time.
PIECE = 1 << 19

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return o - o[0], raw


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, offsets, bytes) of consecutive texts, about ``limit`` bytes at a time.

    A longer text comes in several pieces with the same row number, cut at
    spaces; a run of over ``limit`` bytes without a space is cut anyway, before
    the first byte of a character, and counts as several words.
    """
    if not len(column):
        return
    offsets, raw = flat(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        start, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo == 1 and end - start > limit:
            while start < end:
                cut = min(end, start + limit)
                if cut < end:
                    spaces = np.flatnonzero(SPACE[raw[cut : min(end, cut + limit)]])
                    cut = min(end, cut + (int(spaces[0]) if len(spaces) else limit))
                    cut = head(raw, cut, end)
                yield np.array([lo]), np.array([0, cut - start]), raw[start:cut]
                start = cut
        else:
            yield np.arange(lo, hi), offsets[lo : hi + 1] - start, raw[start:end]
        lo = hi


def head(raw: np.ndarray, at: int, end: int) -> int:
    """The first place from ``at`` on where a character of the UTF-8 bytes begins, at most ``end``."""
    while at < end and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def overlapping(column: pa.Array, reach: int, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Pieces as of :func:`pieces`, each with the bytes that are its own: (row numbers, offsets, bytes, first, end).

    A long text's pieces show ``reach`` bytes more on either side, so that what
    lies near a cut can be seen from both.
    """
    if not len(column):
        return
    offsets, raw = flat(column)
    last, at = -1, 0
    for rows, o, part in pieces(column, limit):
        row = int(rows[0])
        start = at if row == last and len(rows) == 1 else int(offsets[row])
        at, last = start + len(part), row
        lo, hi = int(offsets[row]), int(offsets[rows[-1] + 1])
        if len(rows) > 1 or (start == lo and at == hi):
            yield rows, o, part, 0, len(part)
            continue
        a = start - reach
        a = lo if a <= lo else head(raw, a, start)
        b = min(hi, head(raw, at + reach, hi)) if at + reach < hi else hi
        yield rows, np.array([0, b - a]), raw[a:b], start - a, at - a


def bounds(offsets: np.ndarray, raw: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, index of the text) of every word; no word crosses two texts."""
    if not len(raw):
        none = np.empty(0, np.int64)
        return none, none, none
    solid = ~space[raw]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    first = offsets[:-1]
    before[first[first < len(raw)]] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(solid & ~before)
    return start, np.flatnonzero(solid & ~after) + 1, np.searchsorted(offsets, start, "right") - 1


def scatter_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the words one after the other with ``pad`` free bytes on either side, their starts with the pad)."""
    size = end - start
    at = np.cumsum(size + 2 * pad) - size - 2 * pad
    out = np.zeros(int((size + 2 * pad).sum()), np.uint8)
    run = np.arange(int(size.sum()))
    skip = np.cumsum(size) - size
    out[run + np.repeat(at + pad - skip, size)] = raw[run + np.repeat(start - skip, size)]
    return out, at


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    data, at = scatter_words(raw, start, end)
    place = np.arange(len(data)) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), _STEP))
        h = np.add.reduceat(_BYTE[data] * power[place], at)
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def chained(hashed: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of ``n`` words within a text."""
    if len(hashed) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(hashed) - n + 1
    with np.errstate(over="ignore"):
        h = hashed[:m].copy()
        for k in range(1, n):
            h = h * _STEP + hashed[k : k + m]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return h[at], at
