"""Word and n-gram hashes of UTF-8 text as array operations.

A word's hash is a polynomial in random 64-bit values of its bytes (modulo
2^64, taken from prefix sums, so it doesn't depend on where the word stands),
passed through a mixer. All functions work on pieces of about a megabyte.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_RANDOM = np.random.default_rng(20240607)
VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the maximal runs of bytes b with inside[b]."""
    all_starts, all_ends, all_hashes = [], [], []
    a, n = 0, len(data)
    whole = np.frombuffer(data, np.uint8)
    while a < n:
        b = min(n, a + PIECE)
        if b < n:  # end at a byte outside any word; a longer word makes a longer piece
            back = np.flatnonzero(~inside[whole[a:b]])
            if len(back):
                b = a + int(back[-1]) + 1
            else:
                while b < n and inside[whole[b]]:
                    b += 1
        part = whole[a:b]
        mask = inside[part]
        edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(VALUE[part] * powers(BASE, len(part)), out=sums[1:])
            inverse = pow(BASE, -1, 1 << 64)
            all_starts.append(starts + a)
            all_ends.append(ends + a)
            all_hashes.append(mix((sums[ends] - sums[starts]) * powers(inverse, len(part))[starts]))
        a = b
    if not all_starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return np.concatenate(all_starts), np.concatenate(all_ends), np.concatenate(all_hashes)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values; grams of different k differ."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)
