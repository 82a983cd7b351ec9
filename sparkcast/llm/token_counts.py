"""Token counts of byte-level BPE by a compiled finite-state tokenizer.

``count_tokens`` adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row
of a DataFrame. A text is cut into words by the pre-tokenizer's automaton
(:mod:`pretoken`); each distinct word runs once through the transducer whose
transitions carry emitted-token counts (:mod:`transducer`).

Texts over ``chunk`` bytes are cut into chunks that separate tasks read. Each
sees ``LOOK`` bytes around it, which settles where words and special strings
begin. What it can't see is how far the word that is open at its beginning has
come: its map takes a transducer state there to the state at its end and the
tokens between. A map begins with the one state that the bytes before the chunk
suggest (exact if the word begins among them); states that a chunk's predecessor
ends in and its map lacks are added in rounds, until every map knows all states
it can be entered with. A round costs what is missing: mostly nothing; in a run of
one sign, where the state depends on its length so far, a map is followed through
up to ``ORBIT`` equal chunks at once. Then maps are composed, ``FAN`` neighbours at
a time, by a scan over ranges of chunks (states are written as trie nodes and
token ids, which are the same in every process).

Defined results: null text counts as empty (0 bytes, 0 tokens); strings of
special tokens inside a text count one token each, as the library's default;
repeated rows and repeated ids each keep their row; an empty table gives an
empty result; other columns pass through, and input columns named like the
three new ones are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pretoken, textbytes as tb
from .transducer import START, Transducer, read_json
from .util import save
from .wordcache import WordCache, distinct

CHUNK = 64 << 10        # bytes
LOOK = 256              # bytes seen on either side of a chunk
FAN = 64                # neighbouring maps composed at a time
ORBIT = 256             # states of a run of equal chunks that are followed at once
BETWEEN, INSIDE = b"", b"S"     # states between words, and inside a special string

_counters: dict[str, "Counter"] = {}
tb.kept.append(_counters)


class Counter:
    """Counts the tokens of texts; one per process and vocabulary file."""

    def __init__(self, path: str):
        ids, ranks, special = read_json(path)
        self.transducer = Transducer(ids, ranks)
        cut = [s.encode() for s in special]
        if any(len(s) > LOOK // 2 or any(t.startswith(s[i:]) for t in cut for i in range(1, len(s))) for s in cut):
            raise ValueError("special strings that are long or overlap each other are not supported")
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True))) if special else None
        self.cache = WordCache()

    @staticmethod
    def of(path: str) -> "Counter":
        if path not in _counters:
            _counters[path] = Counter(path)
        return _counters[path]

    def _words(self, buf: np.ndarray, st: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word."""
        if not len(st):
            return np.zeros(0, np.int64)
        keys, at, number = distinct(tb.span_hash(tb.prefix(buf), st, end))
        n = self.cache.find(keys)
        new = np.flatnonzero(n < 0)
        if len(new):
            raw = buf.tobytes()
            found = [raw[s:e] for s, e in zip(st[at[new]].tolist(), end[at[new]].tolist())]
            order = sorted(range(len(found)), key=found.__getitem__)
            n[new[order]] = self.transducer.counts([found[i] for i in order])
            if len(self.cache) + len(new) > self.cache.limit:
                self.cache.clear()
                self.cache.add(keys, n)
            else:
                self.cache.add(keys[new], n[new])
        return n[number]

    def _segments(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each run of bytes between two offsets (no special strings inside)."""
        st = pretoken.starts(buf, offs)
        total = np.concatenate([[0], np.cumsum(self._words(buf, st, np.append(st[1:], len(buf)).astype(np.int64)))])
        return np.diff(total[np.searchsorted(st, offs)])

    def texts(self, col) -> np.ndarray:
        """Tokens of each text of an Arrow string or binary array."""
        out = np.zeros(len(col), np.int64)
        for first, buf, offs in tb.slices(col, (1 << 20) - 1):
            marks = [m.span() for m in self.special.finditer(buf.tobytes())] if self.special else []
            marks = [m for m in marks if np.searchsorted(offs, m[0], "right") == np.searchsorted(offs, m[1], "left")]
            if marks:
                cut = np.sort(np.concatenate([offs, np.array(marks).ravel()]))
                n = self._segments(buf, cut)
                total = np.concatenate([[0], np.cumsum(n)])
                n_text = np.diff(total[np.searchsorted(cut, offs, "right") - 1])
                for a, b in marks:
                    i = np.searchsorted(offs, a, "right") - 1
                    inside = total[np.searchsorted(cut, b, "left")] - total[np.searchsorted(cut, a, "right") - 1]
                    n_text[i] += 1 - inside
            else:
                n_text = self._segments(buf, offs)
            out[first:first + len(n_text)] = n_text
        return out


    def _advance(self, state: bytes, data: bytes) -> tuple[bytes, int]:
        """State after more bytes of an open word, tokens emitted on the way."""
        if state == INSIDE or not data:
            return state, 0
        items = START if state == BETWEEN else tuple(map(tuple, np.frombuffer(state, np.int32).reshape(-1, 3).tolist()))
        items, n = self.transducer.advance(items, data)
        return np.array(items, np.int32).tobytes(), n

    def chunk(self, seen: bytes, a: int, b: int, first: bool, last: bool, states: list[bytes] | None) -> list[tuple[bytes, bytes, int]]:
        """Map of the chunk ``seen[a:b]``: (state before, state after, tokens) of each
        of ``states`` and of those that follow if its bytes come again (in a run
        they do), or of the one its surroundings suggest. ``first``, ``last``: ``seen``
        begins, ends with the text."""
        whole = np.flatnonzero((np.frombuffer(seen, np.uint8) & 0xC0) != 0x80)      # characters that the cuts left whole
        lo, hi = 0 if first else int(whole[0]), len(seen) if last else int(whole[-1])
        seen, a, b = seen[lo:hi], a - lo, b - lo
        buf = np.frombuffer(seen, np.uint8)
        marks = np.array([m.span() for m in self.special.finditer(seen)] if self.special else [], np.int64).reshape(-1, 2)
        st = pretoken.starts(buf, np.unique(np.concatenate([[0, len(buf)], marks.ravel()])))
        before = np.searchsorted(marks[:, 0], st) - 1                               # the last special string that begins earlier
        if len(marks):
            st = st[(before < 0) | (st >= marks[np.maximum(before, 0), 1])]
        k, j = np.searchsorted(st, [a, b])
        special = np.isin(st, marks[:, 0])
        closed = (last and b == len(buf)) or (j < len(st) and st[j] == b)           # no word is open at the end
        end = np.append(st[1:], len(buf))
        inner = slice(k, j if closed else max(j - 1, k))
        n = int(np.where(special[inner], 1, self._words(buf, st[inner], end[inner])).sum())
        out = BETWEEN
        if not closed and j > k:
            if special[j - 1]:
                out, n = INSIDE, n + 1
            else:
                out, more = self._advance(BETWEEN, seen[st[j - 1]:b])
                n += more
        if k < len(st) and st[k] == a:
            return [(BETWEEN, out, n)]
        mended = states is not None
        if not mended:
            states = [INSIDE if k and special[k - 1] else self._advance(BETWEEN, seen[st[k - 1] if k else 0:a])[0]]
        found, head, known = [], seen[a:st[k] if j > k else b], set()
        for s in states:
            for _ in range(ORBIT if mended else 1):
                if s in known or (s == BETWEEN and known):
                    break
                known.add(s)
                t, more = self._advance(s, head)
                found.append((s, out if j > k or closed else t, n + more))
                s = found[-1][1]
        return found


_MAP = "_key string, _no long, _in binary, _out binary, _n long"


def _maps(path: str, given: bool):
    def run(batches):
        c = Counter.of(path)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                for m in c.chunk(r["_seen"], r["_at"], r["_at"] + r["_size"], r["_first"], r["_last"], r["_ins"] if given else None):
                    rows.append((r["_key"], r["_no"], *m))
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 5, kinds)], ["_key", "_no", "_in", "_out", "_n"])
    return run


def _closed_maps(parts: DataFrame, vocabulary: str) -> DataFrame:
    """Maps of all chunks that know every state their predecessors end in."""
    spark = parts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(tasks, "_key", "_no")
    maps = save(parts.mapInArrow(_maps(vocabulary, False), _MAP))
    while True:
        ends = maps.select("_key", (F.col("_no") + 1).alias("_no"), F.col("_out").alias("_in")).distinct()
        asked = ends.join(maps.select("_key", "_no", "_in"), ["_key", "_no", "_in"], "left_anti").groupBy("_key", "_no").agg(F.collect_list("_in").alias("_ins"))
        more = save(parts.join(asked, ["_key", "_no"]).repartition(tasks, "_key", "_no").mapInArrow(_maps(vocabulary, True), _MAP)
                    .join(maps.select("_key", "_no", "_in"), ["_key", "_no", "_in"], "left_anti").select("_key", "_no", "_in", "_out", "_n"))
        if more.isEmpty():
            return maps
        maps = save(maps.unionByName(more))


def _composed(maps: DataFrame, chunks: int) -> DataFrame:
    """Tokens of each text: ``FAN`` neighbouring maps become one until one is left."""
    while True:
        maps = (maps.groupBy("_key", F.expr(f"_no div {FAN}").alias("_block"))
                .agg(F.sort_array(F.collect_list(F.struct("_no", "_in", "_out", "_n"))).alias("_e"))
                .select("_key", "_block", F.explode(F.expr("""
                    transform(filter(_e, x -> x._no = _e[0]._no), x -> aggregate(_e, x, (m, y) ->
                        if(y._no = m._no + 1 and y._in = m._out, named_struct('_no', y._no, '_in', m._in, '_out', y._out, '_n', m._n + y._n), m)))""")).alias("_m"))
                .select("_key", F.col("_block").alias("_no"), "_m._in", "_m._out", "_m._n"))
        if chunks <= FAN:
            return maps.filter(F.col("_in") == F.lit(BETWEEN)).select("_key", "_n")
        chunks = -(-chunks // FAN)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to every row.

    ``vocabulary``: path, on every machine, of a byte-level BPE file with merges."""
    made = ("n_bytes", "n_tokens", "over_limit")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c == text or c not in made])
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.octet_length(raw).cast("long")

    @F.arrow_udf("long")
    def whole(t: pa.Array) -> pa.Array:
        return pa.array(Counter.of(vocabulary).texts(t))

    def done(d):
        return d.withColumns({"n_bytes": size, "n_tokens": F.col("_n")}).withColumn("over_limit", F.col("n_tokens") > limit).drop("_n")

    short = df.filter(size <= chunk).withColumn("_n", whole(raw))
    long = df.filter(size > chunk).withColumn("_key", F.sha2(raw.cast("binary"), 256))
    parts = save(long.groupBy("_key").agg(F.first(raw.cast("binary")).alias("_b"))
                 .select("_key", "_b", F.octet_length("_b").cast("long").alias("_all"), F.explode(F.expr(f"sequence(0L, (octet_length(_b) - 1) div {chunk})")).alias("_no"))
                 .withColumn("_from", F.greatest(F.col("_no") * chunk - LOOK, F.lit(0)))
                 .withColumn("_to", F.least((F.col("_no") + 1) * chunk + LOOK, "_all"))
                 .select("_key", "_no", (F.col("_no") * chunk - F.col("_from")).cast("int").alias("_at"),
                         F.least(F.lit(chunk), F.col("_all") - F.col("_no") * chunk).cast("int").alias("_size"),
                         (F.col("_from") == 0).alias("_first"), (F.col("_to") == F.col("_all")).alias("_last"),
                         F.expr("substring(_b, cast(_from + 1 as int), cast(_to - _from as int))").alias("_seen")))
    chunks = parts.agg(F.max("_no") + 1).first()[0]
    if chunks is None:
        return done(short)
    total = save(_composed(_closed_maps(parts, vocabulary), chunks))
    return done(short).unionByName(done(long.join(total, "_key").drop("_key")))
