"""Vectorised views of a batch of texts as UTF-8 bytes (numpy).

A batch is one byte array plus the start offset of every text. Spans of it
(words, shingles, windows) are hashed from one prefix array, so hashing costs
a few array passes however long the texts are. ``slices`` bounds the memory of
such a pass: it cuts an Arrow column into runs of whole texts of about
``SLICE`` bytes (a longer text makes a slice of its own).
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

SLICE = (512 << 10) - 1

# Spans are told apart by two polynomial hashes modulo the prime 2**31 - 1, each
# with a random base: 62 bits. (Modulo a power of two, every base maps certain
# unequal strings of doubled and swapped halves to one value.)
_PRIME = (1 << 31) - 1
_M, _S = np.uint64(_PRIME), np.uint64(31)
_rng = np.random.default_rng(20240229)
_VALUE = _rng.permutation(256).astype(np.uint64) + np.uint64(1)
_BASES = [int(x) for x in _rng.integers(1 << 20, _PRIME - 1, 2)]
_BLOCK = 1 << 23        # bytes whose weighted values add up within 64 bits
_pow: dict[int, np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, in 0 ... 2**31 - 2."""
    for _ in range(3):
        x = (x & _M) + (x >> _S)
    return np.where(x == _M, np.uint64(0), x)


def _powers(base: int, n: int) -> np.ndarray:
    """The base's powers from 0, at least n of them."""
    a = _pow.get(base, np.ones(1, np.uint64))
    while len(a) < n:
        a = np.concatenate([a, _mod(a * np.uint64(pow(base, len(a), _PRIME)))])
    _pow[base] = a
    return a


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix(buf: np.ndarray) -> np.ndarray:
    """Two rows H with H[j] - H[i] = sum of the weighted bytes i..j-1 (mod the prime)."""
    out = np.zeros((2, len(buf) + 1), np.uint64)
    value = _VALUE[buf]
    for h, base in zip(out, _BASES):
        p = _powers(base, len(buf) + 1)
        for lo in range(0, len(buf), _BLOCK):
            hi = min(lo + _BLOCK, len(buf))
            h[lo + 1:hi + 1] = _mod(np.cumsum(value[lo:hi] * p[lo:hi]) + h[lo])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever the span lies."""
    one, two = (_mod((x[end] + _M - x[start]) * _powers(pow(base, -1, _PRIME), h.shape[1])[start]) for x, base in zip(h, _BASES))
    return mix(one << np.uint64(32) | two)


def column(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None and len(col) else np.empty(0, np.uint8)
    return buf, (o - o[0] if len(col) else np.zeros(1, np.int64))


def release():
    """Give memory that is free in this process back to the system: Python
    workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):       # another C library
    _trim = None


#: What operators keep in a process from task to task (vocabularies, known words).
kept: list[dict] = []


def begin():
    """Called where another operator's task begins: what earlier stages kept
    in this process goes, so that it doesn't add up over a pipeline."""
    for k in kept:
        if k:
            k.clear()
            gc.collect()
    _pow.clear()
    release()


def slices(col, limit: int = SLICE):
    """(first row, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    buf, offs = column(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j
    release()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


#: Bytes between words: white space, or all ASCII but letters and digits.
WHITE = _SPACE
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the runs of other bytes (white space: 09-0D and 20)."""
    if not len(buf):
        return (np.empty(0, np.int64),) * 3
    solid = ~between[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs[:-1]] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_hashes(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, text number)."""
    low = lower(buf)
    s, e, t = words(low, offs, between)
    return span_hash(prefix(low), s, e), t


_MULT = [np.uint64(x | 1) for x in _rng.integers(0, 2**63, 64, dtype=np.uint64).tolist()]


def shingles(w: np.ndarray, t: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of ``k`` words of one text; a text of
    fewer words gives its whole sequence as one. Repeats are kept."""
    n = len(w)
    if not n:
        return w, t
    out_h, out_t = [], []
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h += mix(w[i:n - k + 1 + i]) * _MULT[i]
        same = t[:n - k + 1] == t[k - 1:]
        out_h.append(mix(h[same]))
        out_t.append(t[:n - k + 1][same])
    ids, at, cnt = np.unique(t, return_index=True, return_counts=True)
    short = cnt < k
    for m in range(1, k):
        sel = at[short & (cnt == m)]
        if len(sel):
            h = np.full(len(sel), np.uint64(m), np.uint64)
            for i in range(m):
                h += mix(w[sel + i]) * _MULT[i]
            out_h.append(mix(h + np.uint64(0x5851F42D4C957F2D)))
            out_t.append(t[sel])
    return np.concatenate(out_h), np.concatenate(out_t)


def distinct_by_text(h: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, ordered by text then hash."""
    if not len(h):
        return h, t
    o = np.lexsort((h, t))
    h, t = h[o], t[o]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[keep], t[keep]
