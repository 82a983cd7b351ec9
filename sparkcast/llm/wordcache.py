"""Per-process memory of what has been worked out for distinct words.

Maps a 64-bit word hash to a number. Held as two sorted arrays (16 bytes a
word) and emptied once it holds ``limit`` words, so its size is bounded while
the results stay the same.
"""

from __future__ import annotations

import numpy as np


class WordCache:
    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self.clear()

    def clear(self):
        self.keys = np.empty(0, np.uint64)
        self.values = np.empty(0, np.int64)

    def __len__(self):
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def add(self, keys: np.ndarray, values: np.ndarray):
        """``keys``: sorted, distinct, none of them held."""
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.values = np.insert(self.values, at, values)

    def renumber(self, number: np.ndarray):
        """Value v becomes number[v]; words whose number is negative go."""
        values = number[self.values]
        stay = values >= 0
        self.keys, self.values = self.keys[stay], values[stay]



def distinct(h: np.ndarray):
    """(sorted distinct hashes, an index of each, number of every element's hash)."""
    return np.unique(h, return_index=True, return_inverse=True)
