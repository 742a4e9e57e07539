"""Word shingles of a text as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Odd multipliers of the words of a shingle, and of its final mix.
_ODD = [np.uint64(int(x) | 1) for x in np.random.default_rng(11).integers(1 << 62, 1 << 63, 7, dtype=np.uint64)]

def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased; ASCII white space separates."""
    return text.encode("utf-8", "replace").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``size`` words.

    Fewer words make one shingle of all; no words make none.
    """
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 23)], np.uint64)
    w = word_hashes(words)
    n = len(w) - size + 1
    with np.errstate(over="ignore"):
        h = w[:n] * _ODD[0]
        for k in range(1, size):
            h = (h ^ (h >> np.uint64(29))) * _ODD[5] + w[k : k + n] * _ODD[k % 5]
        h ^= h >> np.uint64(32)
        h *= _ODD[6]
        h ^= h >> np.uint64(29)
    return np.unique(h)
