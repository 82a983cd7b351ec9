"""The pre-tokenizer of byte-level BPE vocabularies as array operations.

``starts`` finds where the matches of the usual pattern (contractions, letter
runs, number runs, other runs, each with one leading blank, then white space)
begin. The pattern is regular with one character of look-ahead, so every
boundary follows from the classes of neighbouring characters.
"""

from __future__ import annotations

import numpy as np

# fixed values: characters with the Unicode property White_Space
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
L, N, S, O = 0, 1, 2, 3
_table: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of every code point, made once per process."""
    global _table
    if _table is None:
        import regex
        t = np.full(0x110000, O, np.uint8)
        every = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4").tobytes().decode("utf-32-le")    # not a Python object a character
        for pat, c in ((r"\p{L}+", L), (r"\p{N}+", N)):
            for m in regex.finditer(pat, every):
                t[ord(m[0][0]):ord(m[0][-1]) + 1] = c
        t[0xD800:0xE000] = O
        t[_WHITE] = S
        _table = t
    return _table


def char_starts(buf: np.ndarray) -> np.ndarray:
    return np.flatnonzero((buf & 0xC0) != 0x80)


def code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code point of each character of valid UTF-8."""
    cp = buf[at].astype(np.uint32)
    wide = np.flatnonzero(cp >= 0xC0)
    if len(wide):
        p = at[wide]
        lead = cp[wide]
        last = len(buf) - 1
        b1, b2, b3 = (buf[np.minimum(p + i, last)].astype(np.uint32) & 0x3F for i in (1, 2, 3))
        cp[wide] = np.where(lead < 0xE0, (lead & 0x1F) << 6 | b1,
                            np.where(lead < 0xF0, (lead & 0x0F) << 12 | b1 << 6 | b2,
                                     (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
    return cp


def starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions where matches begin, over all texts of a batch."""
    if not len(buf):
        return np.empty(0, np.int64)
    at = char_starts(buf)
    cp = code_points(buf, at)
    cl = _classes()[cp]
    n = len(at)
    edge = np.zeros(n + 1, bool)                        # a text begins at this character
    edge[np.searchsorted(at, offs)] = True
    edge[n] = True
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = O, cl[:-1]
    space = cl == S
    begin = edge[:n] | (cl != prev)
    after_blank = np.zeros(n, bool)
    after_blank[1:] = cp[:-1] == 0x20
    begin &= edge[:n] | space | ~after_blank | (prev != S)
    # the last of several blanks before a character that isn't one stands apart
    nxt_solid = np.zeros(n, bool)
    nxt_solid[:-1] = ~space[1:]
    begin |= space & nxt_solid & ~edge[1:]
    # contractions at the start of a match
    q = np.flatnonzero((cp == 0x27) & begin)
    if len(q):
        nx = np.searchsorted(np.flatnonzero(edge), q, "right")
        stop = np.flatnonzero(edge)[nx]                 # end of the text
        a = np.where(q + 1 < stop, cp[np.minimum(q + 1, n - 1)], 0)
        b = np.where(q + 2 < stop, cp[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        mark = np.zeros(n + 1, bool)
        begin[q[one | two] + 1] = False
        mark[(q + 2)[one]] = True
        mark[(q + 3)[two]] = True
        begin |= mark[:n]
    return at[begin]
