"""64-bit hashes of the words of a text, computed for whole texts at a time."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(0x5EED)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        p = np.full(max(n, 1 << 14), base, np.uint64)
        p[0] = 1
        known = _powers[base] = np.multiply.accumulate(p)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(text: str) -> bytes:
    """UTF-8 with A to Z as a to z."""
    return text.encode("utf-8", "replace").lower()


def words_in(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of lowered bytes, in order; ASCII white space parts words."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.empty(len(b) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = SPACE[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE[b] * powers(STEP, len(b)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BACK, len(b))[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word, in order; A to Z count as a to z."""
    return words_in(lowered(text))[0]


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct hashes of ``width`` words in a row, sorted; a shorter text is one shingle, one without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(width, len(w))):
        h = h * np.uint64(STEP) + w[i : i + n] + np.uint64(1)
    return np.unique(mix(h))
