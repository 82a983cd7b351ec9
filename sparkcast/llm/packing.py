"""Packing of documents into sequences of a fixed number of tokens.

``token_pieces`` encodes every text (white space ends a word of these
vocabularies, so texts are put together from the ids of their distinct words),
appends an end id and cuts what is longer than a sequence. ``pack`` then needs
only how many pieces there are of each length: at most ``size`` counts, whatever
the input. From them ``plan`` makes sequences by exact-complement hashing: an
index of single, pair and triple sums of the lengths still available tells for
a gap which combination fills it exactly, and what such a pattern uses is taken
off the counts as many times as they allow. Pieces that no exact combination
closes are packed best fit, longest first. The plan says for each length which
ranks go where; tasks number the pieces of each length as they write them, a
sum over the tasks makes that a rank, and a search in the plan does the rest.
No text is shuffled, and no length, however common, meets in one task.

Bounds: each run of a pattern leaves some length with fewer pieces than the
pattern holds of it, and a length x fits at most size / x times, so there are at
most size * (ln size + 1) runs (about 38,000 at 4096) and rows of the plan for
each distinct length in them, whatever the input; the plan is broadcast.

Defined results: a null text is empty and so holds the end id alone; special
strings inside texts are encoded as the library does by default; repeated rows
and ids each give their own pieces; ties (pieces of one length) may be taken in
any order; an empty table gives an empty result; columns named like the outputs
are replaced, others pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import textbytes as tb
from .util import save
from .wordids import Pieces, gather, spans

MADE = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")

_words: dict[str, Pieces] = {}
tb.kept.append(_words)


class WordEncoder:
    """Ids of many words with few calls: words are joined by a separator that makes
    one token of its own, and taken apart at its id."""

    MARK = "\x01"

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_file(path)
        self.mark = self.t.encode(self.MARK, add_special_tokens=False).ids

    def __call__(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [w.decode() for w in found]
        alone = len(self.mark) != 1 or any(self.MARK in w for w in words)
        step, sep = (1, "") if alone else (1000, f" {self.MARK} ")
        ids = [e.ids for e in self.t.encode_batch_fast([sep.join(words[i:i + step]) for i in range(0, len(words), step)], add_special_tokens=False)]
        if alone:
            return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in (*x, self.mark[0])], np.int64)
        marks = np.flatnonzero(flat == self.mark[0])
        size = np.diff(np.concatenate([[-1], marks])) - 1
        if len(size) != len(words):
            raise ValueError("the separator is no token of its own in this vocabulary")
        return flat[flat != self.mark[0]], size


def _encoder(path: str) -> Pieces:
    if path not in _words:
        _words[path] = Pieces(WordEncoder(path))
    return _words[path]


_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def _words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where their pieces begin): texts, and in them white space behind
    anything else and ASCII signs behind ASCII letters begin a piece; no match of
    the vocabulary's pattern goes beyond. Letters are made small and white space
    blank, as the vocabulary's normalizer does, so that pieces recur; where a special
    string may stand, only white space parts pieces and bytes stay as they are."""
    white = tb.WHITE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = white[1:] & ~white[:-1]
    if b"<|" not in buf.tobytes():
        letter = _LETTER[buf]
        cut[1:-1] |= letter[:-1] & ~letter[1:] & (buf[1:] < 0x80)
        buf = np.where(white, np.uint8(0x20), tb.lower(buf))
    cut[offs] = True
    return buf, np.flatnonzero(cut[:-1])


def _pieces(path: str, size: int, end: int, text: str, keep_ids: bool, schema: pa.Schema):
    def run(batches):
        words = _encoder(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            col = b.column(text)
            rest = b.drop_columns([text])
            for first, buf, offs in tb.slices(col, (1 << 20) - 1):
                buf, st = _words_of(buf, offs)
                n = words.numbers(spans(buf, st)) if len(st) else np.empty(0, np.int64)
                ids, ends = gather(words.pool, words.at, n)
                at = ends[np.searchsorted(st, offs)]                        # where each text's ids begin
                row, no, start, length, crc, kept = [], [], [], [], [], []
                for i in range(len(offs) - 1):
                    own = np.append(ids[at[i]:at[i + 1]], end).astype("<u4")
                    for k in range(0, len(own), size):
                        cut = own[k:k + size]
                        row.append(first + i)
                        no.append(k // size)
                        start.append(k)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        if keep_ids:
                            kept.append(cut.astype(np.int32))
                # number of each piece among the task's pieces of its length
                ln = np.array(length, np.int64)
                order = np.argsort(ln, kind="stable")
                lens, begin, count = np.unique(ln[order], return_index=True, return_counts=True)
                rank = np.empty(len(ln), np.int64)
                rank[order] = np.arange(len(ln)) - np.repeat(begin, count) + np.repeat(seen[lens], count)
                seen[lens] += count
                cols = rest.take(pa.array(row, pa.int64())).columns
                more = [pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(ln), pa.array(crc, pa.int64())]
                more += [pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []
                yield pa.RecordBatch.from_arrays([*cols, *more, pa.array(np.full(len(ln), part, np.int32)), pa.array(rank)], schema=schema)
    return run


def token_pieces(docs: DataFrame, vocabulary: str, size: int = 4096, end: int = 1, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece of every text: the columns of ``docs`` but the text, piece,
    start, length, ids_crc32 (and ids), and the internal _part and _rank.

    ``vocabulary``: path, on every machine, of a tokenizer's file in which white
    space ends words and is dropped. ``end``: id after each text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

    keep = [c for c in docs.columns if c != text and c not in MADE and c not in ("_part", "_rank")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text))
    out = StructType([f for f in rows.schema.fields if f.name != text])
    for name, kind in (("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType())):
        out = out.add(name, kind)
    out = out.add("ids", ArrayType(IntegerType())) if keep_ids else out
    out = out.add("_part", IntegerType()).add("_rank", LongType())
    return rows.mapInArrow(_pieces(vocabulary, size, end, text, keep_ids, to_arrow_schema(out)), out)


class Sums:
    """Availability counts of lengths and the number of pairs of available pieces of each sum."""

    def __init__(self, counts: np.ndarray, size: int, most: int = 3):
        self.n, self.size, self.most = counts.copy(), size, most            # most: pieces of a combination, 1 or 3
        self.have = self.n > 0
        lens = np.flatnonzero(self.have)
        self.pairs = np.zeros(2 * size + 1, np.int64)                       # of two different lengths, or one that is there twice
        for x in lens:
            self.pairs[x + lens[lens > x]] += 1
        self.pairs[2 * np.flatnonzero(self.n > 1)] += 1

    def take(self, x: int, k: int):
        before, self.n[x] = self.n[x], self.n[x] - k
        if before > 1 >= self.n[x]:
            self.pairs[2 * x] -= 1
        if before > 0 >= self.n[x]:
            self.have[x] = False
            self.pairs[x + np.flatnonzero(self.have)] -= 1

    def pair(self, gap: int, used: dict) -> list[int] | None:
        """The pair of available pieces of this sum with the longest first, apart from ``used``."""
        if gap < 2 or gap > 2 * self.size or not self.pairs[gap]:
            return None
        lo = np.arange(max(1, gap - self.size), gap // 2 + 1)
        for b in lo[self.have[lo] & self.have[gap - lo]]:
            a, b = int(gap - b), int(b)
            if self.n[a] - used.get(a, 0) >= 1 + (a == b) and self.n[b] - used.get(b, 0) >= 1 + (a == b):
                return [a, b]
        return None

    def exact(self, gap: int, used: dict) -> list[int] | None:
        """One, two or three available pieces that fill the gap, apart from ``used``."""
        if gap <= self.size and self.n[gap] > used.get(gap, 0):
            return [gap]
        if self.most == 1:
            return None
        two = self.pair(gap, used)
        if two:
            return two
        c = np.arange(1, min(gap - 1, self.size + 1))
        for c in c[self.have[c] & (self.pairs[gap - c] > 0)][::-1]:
            c = int(c)
            if self.n[c] > used.get(c, 0) and (two := self.pair(gap - c, used | {c: used.get(c, 0) + 1})):
                return [c, *two]
        return None

    def longest(self, gap: int, used: dict) -> int | None:
        if self.most == 1:
            return None
        for x in np.flatnonzero(self.have[:gap + 1])[::-1]:
            if self.n[x] > used.get(int(x), 0):
                return int(x)
        return None


def _exact_runs(sums: Sums, size: int):
    """(pattern {length: pieces}, times): full sequences, longest pieces first.
    Lengths that no exact combination closes are set aside."""
    aside = np.zeros_like(sums.n)
    while True:
        lens = np.flatnonzero(sums.have)
        if not len(lens):
            return aside
        first = int(lens[-1])
        used, gap = {first: 1}, size - first
        while gap:
            found = sums.exact(gap, used)
            if not found:
                x = sums.longest(gap, used)                                 # then look again at what is left
                if x is None:
                    break
                found = [x]
            for x in found:
                used[x] = used.get(x, 0) + 1
                gap -= x
        if gap:
            aside[first] += sums.n[first]
            sums.take(first, int(sums.n[first]))
            continue
        times = min(int(sums.n[x]) // k for x, k in used.items())
        for x, k in used.items():
            sums.take(x, k * times)
        yield used, times


def _best_fit(counts: np.ndarray, size: int) -> list[tuple[dict, int]]:
    """Best fit, longest first: groups of sequences with the same pieces, by their gap."""
    by_gap: dict[int, list] = {}
    for x in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[x])
        while n:
            gap = min((g for g in by_gap if g >= x), default=None)
            pattern, bins = by_gap[gap].pop() if gap is not None else ({}, n)
            if gap is not None and not by_gap[gap]:
                del by_gap[gap]
            room = size if gap is None else gap
            each = min(room // x, n)
            m = min(bins, n // each)
            by_gap.setdefault(room - each * x, []).append(({**pattern, x: pattern.get(x, 0) + each}, m))
            if gap is not None and bins > m:
                by_gap.setdefault(gap, []).append((pattern, bins - m))
            n -= m * each
    return [g for groups in by_gap.values() for g in groups]


def _runs(counts: np.ndarray, size: int, most: int) -> list[tuple[dict, int]]:
    sums = Sums(counts, size, most)
    runs, exact = [], _exact_runs(sums, size)
    while True:
        try:
            runs.append(next(exact))
        except StopIteration as e:
            return runs + _best_fit(e.value, size)


def plan(counts: np.ndarray, size: int) -> np.ndarray:
    """Where the pieces of each length go, from how many there are of each
    (index: length). Columns: length, first rank, pieces of it a sequence, first
    sequence, offset of the first in a sequence; ordered by length and rank.

    Combinations of up to three use up short pieces that mid-sized ones may need;
    so the plan is also made with single complements only, and the one of fewer
    sequences holds."""
    counts = np.asarray(counts, np.int64)
    runs = min((_runs(counts, size, most) for most in (3, 1)), key=lambda r: sum(times for _, times in r))
    rows, used, base = [], np.zeros(size + 1, np.int64), 0
    for pattern, times in runs:
        offset = 0
        for x in sorted(pattern, reverse=True):
            rows.append((x, used[x], pattern[x], base, offset))
            used[x] += pattern[x] * times
            offset += pattern[x] * x
        base += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def _place(where, size: int, schema: pa.Schema):
    def run(batches):
        p = where.value
        first = np.searchsorted(p[:, 0], np.arange(size + 2))               # rows of each length
        for b in batches:
            x, r = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            row = np.empty(len(x), np.int64)
            for v in np.unique(x):
                at = np.flatnonzero(x == v)
                row[at] = first[v] + np.searchsorted(p[first[v]:first[v + 1], 1], r[at], "right") - 1
            d, each = r - p[row, 1], p[row, 2]
            more = [pa.array(p[row, 3] + d // each), pa.array(p[row, 4] + d % each * x)]
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["_rank"]).columns, *more], schema=schema)
    return run


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """Add sequence_id and offset to the pieces of :func:`token_pieces`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    pieces = save(pieces)                                                   # the numbering holds for the rows as written
    made = save(pieces.groupBy("_part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(size + 1, np.int64)
    for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect():    # at most ``size`` rows
        counts[r.length] = r.n
    where = pieces.sparkSession.sparkContext.broadcast(plan(counts, size))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = (pieces.join(made.select("_part", "length", before.alias("_before")), ["_part", "length"])
              .select(*[F.col(f"`{c}`") for c in pieces.columns if c not in ("_part", "_rank")], (F.col("_rank") + F.col("_before")).alias("_rank")))
    out = StructType([f for f in ranked.schema.fields if f.name != "_rank"]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(_place(where, size, to_arrow_schema(out)), out)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, spans) of packed pieces that kept their ids: the tokens
    of each sequence and where its pieces lie; a sequence holds ``size`` at most."""
    one = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return (packed.groupBy("sequence_id").agg(one.alias("p"))
            .select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x.offset, x.length)).alias("spans")))
