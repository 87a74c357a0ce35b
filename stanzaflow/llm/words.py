"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside
a multi-byte character, so byte-wise splitting equals splitting by code point. Words are hashed with
a polynomial over the ring of 64-bit integers, followed by a bit mixer; all arithmetic wraps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes looked at in one go; bounds the temporary arrays, which take some 40 bytes for each.
SLICE_BYTES = 1 << 19
#: Runs of words hashed in one go.
RUN_WORDS = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective bit mixer of 64-bit integers (xor-shift and multiply)."""
    x = x + U64(salt * 0x9E3779B97F4A7C15 & _MASK)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=3)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < size."""
    up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def _room(n: int) -> int:
    return max(1 << 20, 1 << int(n).bit_length())


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64), 77)
    if lower:
        values[65:91] = values[97:123]
    return values


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 row offsets into them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; a row boundary ends a word."""
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or one longer row alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of some rows, and the n + 1 offsets of the rows' words."""
    if len(data) == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    start, end = word_bounds(data, offsets)
    values, hashed, at = _byte_values(lower), np.empty(len(start), U64), 0
    while at < len(start):  # words of a slice at a time, so that powers stay short however long a row is
        stop = max(at + 1, int(np.searchsorted(end, start[at] + SLICE_BYTES, "right")))
        a, b = int(start[at]), int(end[stop - 1])
        s, e = start[at:stop] - a, end[at:stop] - a
        up, down = _powers(_P, _room(b - a + 1))
        total = np.zeros(b - a + 1, U64)
        np.cumsum(values[data[a:b]] * up[: b - a], out=total[1:])
        hashed[at:stop] = mix((total[e] - total[s]) * down[s], 1) ^ mix((e - s).astype(U64), 2)
        at = stop
    return hashed, np.searchsorted(start, offsets).astype(np.int64)


def prefix_hashes(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, lengths: tuple[int, ...]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length in bytes: its hashes of the beginnings of words at least as long, and which words these are."""
    values, held = _byte_values(True), np.zeros(len(start), U64)
    for n in range(1, max(lengths) + 1):
        if len(start):
            held = held * U64(_P) + values[data[np.minimum(start + n - 1, len(data) - 1)]]
        if n in lengths:
            ok = np.flatnonzero(end - start >= n)
            yield n, mix(held[ok], 90 + n), ok


def runs(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash for each run of k consecutive words, row boundaries disregarded."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, U64)
    if n > RUN_WORDS:  # in parts that overlap by k - 1 words, so that powers stay short
        return np.concatenate([runs(words[a : a + RUN_WORDS + k - 1], k, salt) for a in range(0, n, RUN_WORDS)])
    up, down = _powers(_Q, _room(len(words) + 1))
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n], 3 + salt)


def within(offsets: np.ndarray, k: int) -> np.ndarray:
    """Word positions at which k words of one row begin."""
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(offsets[-1])
    return np.flatnonzero(left >= k)


def grams(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and their word positions; rows under k words give none."""
    at = within(offsets, k)
    return runs(words, k)[at], at


def shingle_sets(words: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles, ascending in each row, and the n + 1 row offsets. Fewer words: all as one."""
    hashed, at = grams(words, offsets, k)
    row = np.searchsorted(offsets, at, "right") - 1
    count = np.diff(offsets)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = count[short] > j
            whole[has] = mix(whole[has] ^ words[offsets[short[has]] + j], 5 + j)
        hashed, row = np.concatenate([hashed, whole]), np.concatenate([row, short])
    order = np.lexsort((hashed, row))
    hashed, row = hashed[order], row[order]
    if len(hashed):
        new = np.ones(len(hashed), bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
        hashed, row = hashed[new], row[new]
    return hashed, np.searchsorted(row, np.arange(len(count) + 1)).astype(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out
