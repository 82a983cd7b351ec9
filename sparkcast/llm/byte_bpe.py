"""Byte-level BPE encoding and decoding by recursive queries.

Within a task, the distinct words of the texts become token-position rows of an
in-process DuckDB. A recursive query joins neighbouring tokens with the merge
table and contracts each word's leftmost pair of least rank until no pair is
left; an ordered aggregation of the tokens' bytes decodes the words. Words of
over 64 bytes go through the same query in blocks whose seams are checked and
mended (see BLOCK), so that the work grows with a word's length and not with its
square. What is known of a word is kept in the process (bounded in words and
bytes: when full, words that were met again stay), and texts are put together from their words by array operations. The
DuckDB is there only while a batch is encoded: Spark deals tasks to its idle
Python workers in turn, so a machine's memory holds more of them than it has
cores. No text leaves its row: no
shuffle, no driver work, and a lost task is simply run again.

Defined results: a null text is the empty text (no ids, empty bytes); texts of
any length are encoded whole; rows are independent, so ties, repeated rows and
repeated ids need no rule; an empty table gives an empty result; other columns
pass through and input columns named like the outputs are replaced.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pretoken, textbytes as tb
from .wordcache import WordCache, distinct

WORDS = 20_000          # words of one recursive query
KNOWN = 1_000_000       # known words after which those that weren't met again go

MERGE = """
WITH RECURSIVE step AS (
  SELECT w, p, t, false AS done FROM tokens
  UNION ALL
  SELECT w, p, t, done FROM (
    SELECT w, p, CASE WHEN p = best & 4294967295 THEN best >> 32 ELSE t END AS t, best IS NULL AS done,
           lag(p) OVER (PARTITION BY w ORDER BY p) = best & 4294967295 AS gone
    FROM (SELECT *, min(k) OVER (PARTITION BY w) AS best
          FROM (SELECT x.w, x.p, x.t, m.id << 32 | x.p AS k
                FROM (SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS after FROM step WHERE NOT done) x
                LEFT JOIN merges m ON m.pair = x.t << 32 | x.after)))
  WHERE NOT coalesce(gone, false))
SELECT w, list(t ORDER BY p) AS ids, string_agg(bytes, '' ORDER BY p) AS decoded
FROM step JOIN vocabulary ON id = t WHERE done GROUP BY w ORDER BY w
"""

# A longer word is cut into blocks of this many bytes, which the recursive query
# contracts on their own. Tokens t1..tn are what the whole word contracts to just
# if each two neighbours, contracted together, stay as they are: until the first
# merge across a place between two of them, everything else goes on as without
# the rest of the word. So only the seams of blocks are held against that, and
# around a seam that fails the tokens are made again from their bytes.
BLOCK = 32
BESIDE = 3              # tokens on either side of a failed seam made again, one more each round
ROWS = 4_000_000        # token-position rows that one recursive query may keep (half the square of a word's length)
POOL = 16 << 20         # bytes of known words after which those that weren't met again go
SLICE = (256 << 10) - 1  # bytes of texts whose characters are looked at together, at some hundred bytes of arrays each
GROUP = 1 << 20         # bytes of texts whose new words are merged together

_encoders: dict[str, "Encoder"] = {}
tb.kept.append(_encoders)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Encoder:
    """Words to ids and back; one per process and rank file. The rank of a
    token is its id, so of two merges the one that makes the smaller id goes first."""

    def __init__(self, path: str):
        self.ranks = ranks = read_ranks(path)
        pair, made = array("q"), array("q")
        for t, i in ranks.items():
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    pair.append(a << 32 | b), made.append(i)
        self.tables = {"merges": pa.table({"pair": np.frombuffer(pair, np.int64), "id": np.frombuffer(made, np.int64)}),
                       "vocabulary": pa.table({"id": pa.array(ranks.values(), pa.int64()), "bytes": pa.array([t.hex() for t in ranks], pa.string())})}
        self.db = None
        self.token = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes((b,))] for b in range(256)], np.int64)
        self.cache = WordCache(KNOWN)
        self.fits: dict[tuple[int, int], bool] = {}
        # ids and bytes of known words, one after the other; where each begins; whether it was met again
        self.ids, self.raw = np.empty(0, np.int32), np.empty(0, np.uint8)
        self.id_at, self.raw_at = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.again = np.empty(0, bool)

    @staticmethod
    def of(path: str) -> "Encoder":
        if path not in _encoders:
            tb.begin()
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _open(self):
        import duckdb
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "512MB"})
        self.db.execute("SET preserve_insertion_order = false")
        for name, table in self.tables.items():
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _close(self):
        """The database's memory goes back to the system; the next batch's new words open another."""
        if self.db is not None:
            self.db.close()
            self.db = None
            tb.release()

    def _reset(self):
        self.again[:] = False
        self.fits.clear()
        self._forget()

    def _forget(self):
        """Of the known words stay those that were met again since the last
        time, the first of them, up to half of what may be kept."""
        stay = np.flatnonzero(self.again)[:self.cache.limit // 2]
        stay = stay[np.cumsum(self.raw_at[stay + 1] - self.raw_at[stay]) <= POOL // 2]
        number = np.full(len(self.again), -1, np.int64)
        number[stay] = np.arange(len(stay))
        self.cache.renumber(number)
        (self.ids, self.id_at), (self.raw, self.raw_at) = self._gather(self.ids, self.id_at, stay), self._gather(self.raw, self.raw_at, stay)
        self.again = np.zeros(len(stay), bool)

    def _contract(self, words: list[bytes]) -> tuple[list[list[int]], list[bytes]]:
        """Ids and decoded bytes of each word, from its single bytes, by recursive queries."""
        if words and self.db is None:
            self._open()
        ids: list = [None] * len(words)
        back: list = [None] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        lo = 0
        while lo < len(words):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:lo + WORDS] ** 2) // 2, ROWS)))
            n = size[lo:hi]
            w = np.repeat(np.arange(len(n)), n)
            p = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            self.db.register("tokens", pa.table({"w": w, "p": p, "t": self.byte[np.frombuffer(b"".join(words[lo:hi]), np.uint8)]}))
            got = self.db.sql(MERGE).to_arrow_table()
            self.db.unregister("tokens")
            for i, x, y in zip(got["w"].to_pylist(), got["ids"].to_pylist(), got["decoded"].to_pylist()):
                ids[lo + i], back[lo + i] = x, bytes.fromhex(y)
            lo = hi
        return ids, back

    def merged(self, words: list[bytes]) -> tuple[list[list[int]], list[bytes]]:
        """Ids and decoded bytes of each word. A word that is a token is that token."""
        whole = [self.ranks.get(w, -1) for w in words]
        ids: list = [[i] if i >= 0 else None for i in whole]
        back: list = [self.token[i] if i >= 0 else None for i in whole]
        for is_long, make in ((False, self._contract), (True, self._long)):
            place = [i for i, w in enumerate(words) if whole[i] < 0 and (len(w) > 2 * BLOCK) == is_long]
            for i, x, y in zip(place, *make([words[i] for i in place])):
                ids[i], back[i] = x, y
        return ids, back

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neighbouring tokens a, b stay as they are when contracted together."""
        pairs = list(zip(a.tolist(), b.tolist()))
        new = [x for x in dict.fromkeys(pairs) if x not in self.fits]
        for x, got in zip(new, self._contract([self.token[x] + self.token[y] for x, y in new])[0]):
            self.fits[x] = got == list(x)
        out = np.array([self.fits[x] for x in pairs], bool)
        if len(self.fits) > self.cache.limit // 4:
            self.fits.clear()
        return out

    def _long(self, words: list[bytes]) -> tuple[list[list[int]], list[bytes]]:
        """Ids and decoded bytes of long words: blocks, then their seams."""
        blocks = [[w[k:k + BLOCK] for k in range(0, len(w), BLOCK)] for w in words]
        known = dict.fromkeys(x for parts in blocks for x in parts)
        known = dict(zip(known, self._contract(list(known))[0]))
        # all words' tokens in one row; a seam lies before its token; first marks the first token of a word
        runs = [known[x] for parts in blocks for x in parts]
        t = np.array([i for x in runs for i in x], np.int64)
        begin = np.cumsum([0] + [len(x) for x in runs[:-1]]) if runs else np.empty(0, np.int64)
        first = np.zeros(len(t), bool)
        first[begin[np.cumsum([0] + [len(x) for x in blocks[:-1]])] if blocks else []] = True
        seam = np.zeros(len(t), bool)
        seam[begin] = True
        beside = BESIDE
        while True:
            seam &= ~first
            at = np.flatnonzero(seam)
            seam[at[self._fit(t[at - 1], t[at])]] = False
            bad = np.flatnonzero(seam)
            if not len(bad):
                break
            edge = np.append(np.flatnonzero(first), len(t))
            word = np.searchsorted(edge, bad, "right")
            spans, done = [], -1
            for lo, hi in zip(np.maximum(bad - beside, edge[word - 1]).tolist(), np.minimum(bad + beside, edge[word]).tolist()):
                if lo >= done:      # the seams of overlapping stretches wait for the next round
                    spans.append((lo, hi))
                    done = hi
            raw = [b"".join(map(self.token.__getitem__, t[lo:hi].tolist())) for lo, hi in spans]
            made = dict.fromkeys(raw)
            made = dict(zip(made, self._contract(list(made))[0]))
            parts, marks, firsts, last = [], [], [], 0
            for (lo, hi), x in zip(spans, raw):
                new = np.array(made[x], np.int64)
                start = np.zeros(len(new), bool)
                start[0] = True
                parts += [t[last:lo], new]
                marks += [seam[last:lo], start]
                firsts += [first[last:lo], start & first[lo]]
                last = hi
                if hi < len(t):
                    seam[hi] = True
            t = np.concatenate(parts + [t[last:]])
            seam = np.concatenate(marks + [seam[last:]])
            first = np.concatenate(firsts + [first[last:]])
            beside += 1
        ids = [x.tolist() for x in np.split(t, np.flatnonzero(first)[1:])] if words else []
        return ids, [b"".join(map(self.token.__getitem__, x)) for x in ids]

    def _numbers(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Number among the known words of each word of some slices: (bytes, where words begin, their hashes)."""
        keys, at, number = distinct(np.concatenate([h for _, _, h in parts]))
        if len(self.cache) > self.cache.limit or len(self.raw) > POOL:
            self._forget()
        n = self.cache.find(keys)
        self.again[n[n >= 0]] = True
        new = np.flatnonzero(n < 0)
        if len(new):
            first = np.cumsum([0] + [len(st) for _, st, _ in parts])
            part = np.searchsorted(first, at[new], "right") - 1
            raw = [buf.tobytes() for buf, _, _ in parts]
            edge = [np.append(st, len(buf)) for buf, st, _ in parts]
            id_at, raw_at, all_ids, all_raw = [self.id_at], [self.raw_at], [self.ids], [self.raw]
            part, at = part.tolist(), (at[new] - first[part]).tolist()
            for lo in range(0, len(new), WORDS):        # Python objects of so many words at once
                ids, back = self.merged([raw[k][edge[k][i]:edge[k][i + 1]] for k, i in zip(part[lo:lo + WORDS], at[lo:lo + WORDS])])
                id_at.append(id_at[-1][-1] + np.cumsum([len(x) for x in ids]))
                raw_at.append(raw_at[-1][-1] + np.cumsum([len(x) for x in back]))
                all_ids.append(np.fromiter((i for x in ids for i in x), np.int32))
                all_raw.append(np.frombuffer(b"".join(back), np.uint8))
            n[new] = len(self.id_at) - 1 + np.arange(len(new))
            self.cache.add(keys[new], n[new])
            self.id_at, self.raw_at, self.ids, self.raw = (np.concatenate(x) for x in (id_at, raw_at, all_ids, all_raw))
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return n[number]

    @staticmethod
    def _gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pool's runs of words n, joined; where each word's run begins and the last ends."""
        size = at[n + 1] - at[n]
        ends = np.concatenate([[0], np.cumsum(size)])
        return pool[np.repeat(at[n] - ends[:-1], size) + np.arange(ends[-1])], ends

    @staticmethod
    def _groups(col):
        """Slices in groups: (bytes, offsets, where words begin, their hashes) of each."""
        parts, size = [], 0
        for _, buf, offs in tb.slices(col, SLICE):
            st = pretoken.starts(buf, offs)
            parts.append((buf, offs, st, tb.span_hash(tb.prefix(buf), st, np.append(st[1:], len(buf)).astype(np.int64)[:len(st)])))
            size += len(buf)
            if size >= GROUP:
                yield parts
                parts, size = [], 0
        if parts:
            yield parts

    def encode(self, col, decode: bool = True) -> pa.StructArray:
        """ids: list of int32 and, if asked for, decoded: binary, of each text."""
        ids, raw, id_end, raw_end = [], [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for parts in self._groups(col):
            n = self._numbers([(buf, st, h) for buf, _, st, h in parts])
            for _, offs, st, _ in parts:
                here, n = n[:len(st)], n[len(st):]
                first = np.searchsorted(st, offs)
                i, i_ends = self._gather(self.ids, self.id_at, here)
                r, r_ends = self._gather(self.raw, self.raw_at, here) if decode else (np.empty(0, np.uint8), np.zeros(len(here) + 1, np.int64))
                ids.append(i)
                raw.append(r)
                id_end.append(id_end[-1][-1] + i_ends[first[1:]])
                raw_end.append(raw_end[-1][-1] + r_ends[first[1:]])
        self._close()
        cat = lambda x, d: np.concatenate(x) if x else np.empty(0, d)
        at = pa.array(cat(id_end, np.int64), pa.int32())
        lists = pa.ListArray.from_arrays(at, pa.array(cat(ids, np.int32)))
        if not decode:
            return lists
        data = cat(raw, np.uint8)
        binary = pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(cat(raw_end, np.int64).astype(np.int32)), pa.py_buffer(data)])
        return pa.StructArray.from_arrays([lists, binary], ["ids", "decoded"])


def encode(df: DataFrame, ranks: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids (array of int) of every text."""
    @F.arrow_udf("array<int>")
    def ids_of(t: pa.Array) -> pa.Array:
        return Encoder.of(ranks).encode(t, decode=False)

    keep = [F.col(f"`{c}`") for c in df.columns if c != ids]
    return df.select(*keep, ids_of(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias(ids))


def encode_decode(df: DataFrame, ranks: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the token ids (array of int) of every text and the bytes they decode to.

    ``ranks``: path, on every machine, of the file of tokens and their ranks."""
    @F.arrow_udf("ids array<int>, decoded binary")
    def both(t: pa.Array) -> pa.Array:
        return Encoder.of(ranks).encode(t)

    keep = [F.col(f"`{c}`") for c in df.columns if c not in (ids, decoded)]
    return (df.select(*keep, both(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_both"))
            .select(*keep, F.col("_both.ids").alias(ids), F.col("_both.decoded").alias(decoded)))
