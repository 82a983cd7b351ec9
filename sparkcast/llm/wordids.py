"""Token ids of texts by way of their distinct pieces.

Many tokenizers never look across certain places of a text (white space, say).
``Pieces`` splits a batch there, numbers the distinct pieces exactly (Arrow's
dictionary over their bytes, no hashes of ours), encodes those it hasn't met
with the tokenizer's own library and gathers the ids. What it keeps is bounded
by ``limit`` bytes and starts anew beyond it: memory only, same ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def spans(buf: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The pieces of ``buf`` between successive starts (and its end), without a copy."""
    offs = np.append(starts, len(buf)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(buf))])


def gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's runs of pieces n, joined; where each run begins and the last ends."""
    size = at[n + 1] - at[n]
    ends = np.zeros(len(n) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return pool[np.repeat(at[n] - ends[:-1], size) + np.arange(ends[-1])], ends


class Pieces:
    """Numbers and ids of distinct pieces; ``encode`` maps a list of byte strings to
    (all ids joined, how many each has)."""

    def __init__(self, encode, limit: int = 64 << 20):
        self.encode, self.limit = encode, limit
        self.reset()

    def reset(self):
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.pool, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """Number of each piece among the known ones, for ``pool`` and ``at``."""
        if self.size > self.limit:
            self.reset()
        d = pieces.dictionary_encode()
        words = d.dictionary.to_pylist()
        n = np.array([self.known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(n < 0)
        if len(new):
            found = [words[i] for i in new]
            ids, size = self.encode(found)
            n[new] = len(self.at) - 1 + np.arange(len(new))
            self.known.update(zip(found, n[new].tolist()))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
            self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
            self.size += sum(map(len, found)) + 150 * len(found) + 4 * len(ids)
        return n[d.indices.to_numpy(zero_copy_only=False)]
