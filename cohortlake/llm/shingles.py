"""Word shingles of many texts at once, as 64-bit hashes computed on flat byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(2**62, 2**63, dtype=np.uint64)) | 1
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word between ASCII white space, A-Z lower-cased, and the number of the first word of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    lower = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[at] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:n]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[lower] * power[:n], out=total[1:])
    words = scrambled((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    return words, np.searchsorted(first, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text: k words each, or all words of a text with fewer."""
    words, begins = word_hashes(data, at)
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        grams += words[i : i + len(grams)] * _PLACE[i]
    grams = scrambled(grams)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            yield own[keep]
        elif b > a:
            yield scrambled((words[a:b] * _PLACE[k : k + b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
