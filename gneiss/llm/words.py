"""Words of texts as 64-bit hashes, for whole blocks of texts at a time.

Words are runs of bytes other than a blank and U+0009 to U+000D. A word's hash is a polynomial over random 64-bit values
of its bytes, taken from prefix sums over the block, so no loop touches single words.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.frombuffer(b"".join(sha256(b"word%d" % i).digest()[:8] for i in range(256)), "<u8").astype(np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int):
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers = tuple(tables)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (the finaliser of splitmix64); one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, in order, and where each text's words begin (one more entry than texts). fold: A-Z as a-z."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if fold:
        data = _LOWER[data]
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = _SPACE[data]
    change = np.diff(space)
    starts, ends = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * power[: len(data)], out=sums[1:])
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, at)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each word; those that cross into the next text are for the caller to leave out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = hashes[: len(hashes) - n + 1].copy()
    for j in range(1, n):
        total = total * _BASE + hashes[j : len(hashes) - n + 1 + j]
    return mix(total + np.uint64(n))


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of a whole sequence, equal to gram_hashes for n = its length."""
    return gram_hashes(hashes, len(hashes))[0]
