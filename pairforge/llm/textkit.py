"""Words and their hashes, by numpy over the bytes of many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NOT_ALNUM = np.zeros(256, bool)
_NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 1 << 23:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Words:
    """hash, start and end (bytes) of each word; doc k has the words first[k]:first[k+1]; data: the bytes."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: list[str], kind: str = "space", lower: bool = True) -> Words:
    """kind space: words are runs of anything but 0x20 and 0x09-0x0D; alnum: runs of a-z, 0-9 and non-ASCII, after lower-casing."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    out = (_SPACE if kind == "space" else _NOT_ALNUM)[data]
    edge = np.diff(np.concatenate(([True], out, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(data)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=total[1:])
    h = mix((total[end] - total[start]) * _power("down", _INVERSE, n)[start])
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    begins = np.concatenate(([0], np.cumsum(length + 1)))
    return Words(h, start, end, np.searchsorted(start, begins), data)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive hashes; grams may span two documents, see within()."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = U((0xD6E8FEB86659FD93 + 0x1234567890ABCDE2 * seed) % 2**64 | 1)
    out = h[:n].copy()
    for j in range(1, k):
        out *= base
        out += h[j : n + j]
    return mix(out)


def within(w: Words, k: int) -> np.ndarray:
    """Whether the k words from each place on lie in one document."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.empty(0, bool)
    left = np.repeat(w.first[1:], np.diff(w.first))[:n]
    return np.arange(n) + k <= left


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
