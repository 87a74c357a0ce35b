"""Hashed draws in numpy: numbers that depend on their parts alone, in 32 bits that other engines can repeat."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np

#: The factor of the mixer, and 32 bits.
FACTOR, MASK = np.uint64(0x45D9F3B), np.uint64(0xFFFFFFFF)
_HALF = np.uint64(16)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 32-bit numbers: shifts, exclusive or, and a factor, twice."""
    x = ((x >> _HALF) ^ x) * FACTOR & MASK
    x = ((x >> _HALF) ^ x) * FACTOR & MASK
    return (x >> _HALF) ^ x


def mixed32(x: np.ndarray) -> np.ndarray:
    """mixed of an array of uint32, in place: half the bytes, and factors that wrap by themselves."""
    high = x >> np.uint32(16)
    for _ in range(2):
        x ^= high
        x *= np.uint32(FACTOR)
        np.right_shift(x, np.uint32(16), out=high)
    x ^= high
    return x


def base(*parts: object) -> np.ndarray:
    """Where draws begin: 32 bits of an MD5 of what names them."""
    return np.uint64(int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16))


def drawn(start: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """A number below 2^32 for each combination of whole numbers (broadcast): each part is mixed in turn, in words of 32 bits."""
    for part in parts:
        part = np.asarray(part).astype(np.uint64)
        start = mixed(start ^ (part & MASK))
        if part.size and int(part.max()) >> 32:
            start = np.where(part >> np.uint64(32), mixed(start ^ (part >> np.uint64(32))), start)
    return start


def places(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hashed numbers as places below n (below 2^31)."""
    return ((hashed * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


#: Normal quantiles at logits of probabilities, as first guesses.
_LOGITS = np.linspace(-28, 28, 2049)
_NORMAL = np.array([NormalDist().inv_cdf(1 / (1 + math.exp(-x))) for x in _LOGITS])
#: Binomials whose tails are summed together: arrays that a core's cache holds.
_TOGETHER = 1 << 12
_SMALL = np.array([math.lgamma(i + 1) for i in range(128)])


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 1).astype(float)
    series = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < len(_SMALL), _SMALL[np.minimum(n, len(_SMALL) - 1)], series)


def binomial(k: np.ndarray, p: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """For each k, p and u in [0, 1) (broadcast) the least x with P(Binomial(k, p) <= x) > u: its inverse distribution function."""
    k, p, u = np.broadcast_arrays(np.asarray(k, np.int64), np.asarray(p, float), u)
    shape, (k, p, u) = k.shape, (x.ravel() for x in (k, p, u))
    out = np.where(p >= 1, k, 0)
    open_ = np.flatnonzero((p > 0) & (p < 1) & (k > 0))
    for lo in range(0, len(open_), _TOGETHER):
        at = open_[lo : lo + _TOGETHER]
        out[at] = _inverse(k[at], p[at], u[at])
    return out.reshape(shape)


def _inverse(k: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The tail below a first guess is summed in steps that shrink it to nothing, some ten standard deviations; then x moves to where it belongs."""
    q, sd = 1 - p, np.sqrt(k * p * (1 - p))
    inner = np.clip(u, 1e-12, 1 - 1e-12)
    z = np.interp(np.log(inner / (1 - inner)), _LOGITS, _NORMAL)
    x = np.clip(np.floor(k * p + z * sd), 0, k).astype(np.int64)
    here = np.exp(_log_factorial(k) - _log_factorial(x) - _log_factorial(k - x) + x * np.log(p) + (k - x) * np.log1p(-p))
    total, term, odds = np.ones(len(k)), np.ones(len(k)), q / p
    over, under, ratio = x.astype(float), (k - x + 1).astype(float), np.empty(len(k))
    while term.max() > 1e-18:
        for _ in range(8):  # a term of 0 stays 0
            np.divide(over, under, out=ratio)
            ratio *= odds
            term *= ratio
            total += term
            over -= 1
            under += 1
    below = here * total
    while (move := (below - here > u) & (x > 0)).any():
        below = np.where(move, below - here, below)
        here = np.where(move, here * (x * q) / ((k - x + 1) * p), here)
        x = x - move
    while (move := (below <= u) & (x < k)).any():
        here = np.where(move, here * ((k - x) * p) / ((x + 1) * q), here)
        x = x + move
        below = np.where(move, below + here, below)
    return x
