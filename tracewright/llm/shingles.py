"""Words and hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * A
    x = (x ^ (x >> np.uint64(27))) * B
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, in order."""
    n = len(h) - k + 1
    out = np.full(n, C + np.uint64(k))
    for i in range(k):
        out = scrambled(out + h[i : i + n])
    return out


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z count as a-z.

    Words are what ASCII white space separates. Of fewer than k words the whole sequence is one shingle; without
    words the set is empty.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolled(word_hashes(words), min(k, len(words))))
