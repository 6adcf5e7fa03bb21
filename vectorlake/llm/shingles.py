"""Word and shingle hashes of texts, in numpy over whole batches."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words whose hashes a worker remembers; emptied when full.
REMEMBERED = 400_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hash of each word (bytes)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _factor(i: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(b"place %d" % i).digest()[:8], "little") | 1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, given the words' hashes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    last = len(hashes) - n + 1
    total = np.zeros(last, np.uint64)
    for i in range(n):
        total += hashes[i : i + last] * _factor(i)
    return mixed(total)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingle hashes; a shorter text's whole word sequence is its only one, no words give none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    if len(hashes) < n:
        return mixed(grams(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(grams(hashes, n))
