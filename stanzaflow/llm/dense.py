"""Exact inner products of blocks of vectors whose components are scaled and rounded down, and running lists of the best.

Rows are told apart by magnitude: where all partial sums stay below 2^53 a block is one float64 matrix product, where they
stay below 2^62 one of 64-bit integers, and only pairs with a row beyond that are summed in unbounded integers, in small slices. A few
huge rows thus don't make the work of the others dear. Peak memory is some 50 MB besides the rows, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa

#: Scaled components below this are exact as doubles and as 64-bit integers.
EXACT = float(1 << 53)
#: Scores made at once: of 64 bits, and unbounded ones.
SCORES, WIDE_SCORES = 1 << 20, 1 << 15
#: Bytes of a score that doesn't fit into 64 bits, whose components are below 2^1034.
_WIDE = 280
_ENDS = (-(1 << 63), (1 << 63) - 1)
#: Below all scores of 64 bits that occur.
_NONE = -(1 << 63) + 1


def floors(rows: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x), exact as a double unless that is too large for one."""
    with np.errstate(over="ignore"):
        return np.floor(factor * rows)


def whole(rows: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) in unbounded integers. Doubles from 2^53 on are whole numbers themselves."""
    scaled = floors(rows, factor)
    tame = np.abs(scaled) < EXACT
    out = np.where(tame, scaled, 0).astype(np.int64).astype(object)
    out[~tame] = [int(x) * factor if abs(x) >= EXACT else int(np.floor(factor * x)) for x in rows[~tame].tolist()]
    return out


def products(queries: np.ndarray, data: np.ndarray, factor: int) -> np.ndarray:
    """Integer inner products, in doubles where these are exact, else in 64-bit or unbounded integers."""
    q, d = floors(queries, factor), floors(data, factor)
    high, wide = np.abs(q).max(initial=0), np.abs(d).max(initial=0)
    if max(high, wide) < EXACT:
        most = int(high) * int(wide) * max(1, d.shape[1])
        if most < 1 << 53:
            return (q @ d.T).astype(np.int64)
        if most < 1 << 62:
            return q.astype(np.int64) @ d.astype(np.int64).T
    return whole(queries, factor) @ whole(data, factor).T


def levels(rows: np.ndarray, factor: int) -> np.ndarray:
    """0, 1 or 2 for each row: pairs of rows of a level at most this need doubles, 64-bit or unbounded integers."""
    most, n = np.abs(floors(rows, factor)).max(1, initial=0), max(1, rows.shape[1])
    return (most > isqrt(((1 << 53) - 1) // n)).astype(int) + (most > min(isqrt(((1 << 62) - 1) // n), (1 << 53) - 1))


def score_blocks(queries: np.ndarray, data: np.ndarray, factor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries, places of data and their scores, in slices that cover all pairs once."""
    if not len(queries) or not len(data):
        return
    mine, theirs = levels(queries, factor), levels(data, factor)
    for level in range(3):
        for some, others in ((mine <= level, theirs == level), (mine == level, theirs < level)):
            q, d = np.flatnonzero(some), np.flatnonzero(others)
            size = WIDE_SCORES if level == 2 else SCORES
            across = max(1, min(len(d), size))
            down = max(1, size // across)
            for hi in range(0, len(d), across):
                part = d[hi : hi + across]
                for lo in range(0, len(q), down):
                    own = q[lo : lo + down]
                    yield own, part, products(queries[own], data[part], factor)


class Best:
    """The k best (score, id) of each of n rows, ties to smaller ids, under blocks that come in any order."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score, self.ids = np.full((n, k), _NONE, np.int64), np.full((n, k), _ENDS[1], np.int64)
        self.wide: dict[int, list[tuple[int, int]]] = {}  # (-score, id) of the rows that met unbounded scores

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray) -> None:
        """scores[i, j] of id ids[j] goes to row rows[i] where it is allowed."""
        if scores.dtype == object:
            for row, own, ok in zip(rows.tolist(), scores, allowed, strict=True):
                held = self.wide.get(row, [])
                self.wide[row] = sorted([*held, *zip((-own[ok]).tolist(), ids[ok].tolist(), strict=True)])[: self.k]
            return
        at, step = 0, max(64, 8 * self.k)
        while at < len(ids):  # the first columns are few, so that later ones meet a bar
            part, own = scores[:, at : at + step], ids[at : at + step]
            bar, bar_id = self.score[rows, -1], self.ids[rows, -1]
            i, j = np.nonzero((part >= bar[:, None]) & allowed[:, at : at + step])
            score, name = part[i, j], own[j]
            better = (score > bar[i]) | (name < bar_id[i])
            self._merge(rows, i[better], score[better], name[better])
            at, step = at + step, step * 4

    def _merge(self, rows: np.ndarray, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(i)
        if not len(touched):
            return
        i = np.concatenate([np.repeat(touched, self.k), i])
        score = np.concatenate([self.score[rows[touched]].ravel(), score])
        ids = np.concatenate([self.ids[rows[touched]].ravel(), ids])
        order = np.lexsort((ids, -score, i))
        first = np.searchsorted(i[order], touched)
        kept = order[first[:, None] + np.arange(self.k)[None]]
        self.score[rows[touched]], self.ids[rows[touched]] = score[kept], ids[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
        """Row, id and score of all that are held; the score clipped to 64 bits, and where it is clipped also as bytes in its order."""
        row, place = np.nonzero(self.score > _NONE)
        ids, score = self.ids[row, place], self.score[row, place]
        more = [(r, i, -s) for r, held in self.wide.items() for s, i in held]
        wide = [None] * len(row) + [to_bytes(s) for _, _, s in more]
        row = np.concatenate([row, np.array([r for r, _, _ in more], np.int64)])
        ids = np.concatenate([ids, np.array([i for _, i, _ in more], np.int64)])
        return row, ids, np.concatenate([score, np.array([min(max(s, _ENDS[0]), _ENDS[1]) for _, _, s in more], np.int64)]), wide


def to_bytes(score: int) -> bytes | None:
    """A score at or beyond an end of 64 bits as bytes in its order; None for others."""
    return None if _ENDS[0] < score < _ENDS[1] else (score + (1 << 8 * _WIDE - 1)).to_bytes(_WIDE, "big")


def from_bytes(score: int, wide: bytes | None) -> int:
    """The score that to_bytes() was given."""
    return score if wide is None else int.from_bytes(wide, "big") - (1 << 8 * _WIDE - 1)


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of each vector length in a column of arrays of doubles."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat, at = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        yield own, flat[at[own][:, None] + np.arange(n)[None]]
