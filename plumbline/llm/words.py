"""Words of a text as 64-bit hashes, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: A process keeps the hashes of so many words.
KEPT = 150_000

#: Odd multipliers that set the places of a sequence apart.
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1 for i in range(64)], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT:
            self[word] = h
        return h


_hashes = _Hashes()


def words(text: str, lower: bool = True) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8; A-Z lower-cased if asked for."""
    raw = text.encode()
    return (raw.lower() if lower else raw).split()


def hashes(some: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(_hashes.__getitem__, some), np.uint64, len(some))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words than k, of the whole sequence as one."""
    k = min(k, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    s = h[:n] * PLACES[0]
    for i in range(1, k):
        s = s + h[i : i + n] * PLACES[i]
    return np.unique(mix(s + np.uint64(k)))
