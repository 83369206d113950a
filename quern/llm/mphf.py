"""A minimal perfect hash over 64-bit keys in numpy, with the keys stored for verification."""

from __future__ import annotations

import numpy as np

from quern.llm.common import splitmix

#: Places per key at each level; more make lookups shorter and bits longer.
SPREAD = 2


class PerfectHash:
    """Maps each of n distinct keys to a slot of its own in 0..n-1.

    Each level has a bit for every place that exactly one remaining key hashes to; the others
    go to the next level, and a slot is the rank of its bit. Any other key gets some slot too,
    so the keys are kept in slot order and compared."""

    def __init__(self, keys: np.ndarray):
        self.n, self.levels, rest, base = len(keys), [], keys, 0
        while len(rest):
            size = 64 * -(-SPREAD * len(rest) // 64)
            place = self._places(rest, len(self.levels), size)
            once = np.bincount(place, minlength=size) == 1
            words = np.packbits(once, bitorder="little").view(np.uint64)
            ranks = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((size, words, ranks[:-1]))
            base, rest = int(ranks[-1]), rest[~once[place]]
        self.keys = np.empty(self.n, np.uint64)
        self.keys[self._slots(keys)] = keys

    @staticmethod
    def _places(g: np.ndarray, level: int, size: int) -> np.ndarray:
        return (splitmix(g + np.uint64(level * 0x9E37)) % np.uint64(size)).astype(np.int64)

    def _slots(self, g: np.ndarray) -> np.ndarray:
        """Some slot for each key, -1 where no level has its bit."""
        out, left = np.full(len(g), -1, np.int64), np.arange(len(g))
        for level, (size, words, ranks) in enumerate(self.levels):
            place = self._places(g[left], level, size)
            word, bit = words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = ranks[place[hit] >> 6] + below
            left = left[~hit]
            if not len(left):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that were not given."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        at = self._slots(keys)
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1)
