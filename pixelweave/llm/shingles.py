"""Word shingles as 64-bit hashes, and what follows from a document's set of them."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sets of 5-word shingles; a shingle's hash mixes the 64-bit hashes of its words in order."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct shingles of a text, sorted; of fewer words the whole sequence as one; of none, nothing."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(words))
        size = len(words) - n + 1
        out = np.full(size, len(words) if n < self.words else self.words, np.uint64)
        for i in range(n):
            out = (out ^ h[i : i + size]) * MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def needed(n: int, percent: int) -> int:
    """The least intersection with a set of any size that links a set of n: 100 * i >= percent * n."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    """Two sets that link share an element among so many of each one's first, in any common order."""
    return n - needed(n, percent) + 1
