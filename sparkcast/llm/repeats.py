"""Repeated passages by longest-previous-factor arrays over sampled suffixes.

A passage repeats where two suffixes of the corpus share their first ``size``
bytes. Suffixes that share that much lie side by side in suffix order; in it
the previous and the next smaller position of a suffix are its earlier matches,
and the longest previous factor is at least ``size`` where one of them has such
a common prefix. Only that threshold matters here, so the order is kept for
prefixes of ``size`` bytes: suffixes with one prefix form a class.

The corpus is never sorted as a whole. Each window of ``size`` bytes has one
anchor, the leftmost k-gram of least hash inside it: equal windows have equal
anchors, so a window repeats only if the hash of its anchor does. Consecutive
windows of one anchor form a run; a run whose anchor hash occurs once is
settled by a count. Runs of a repeated anchor with the same bytes around are
one context, equal throughout. Only where an anchor has several contexts are
their suffixes put in order (one context each), in a task per anchor, or, for
anchors with over ``CONTEXTS`` contexts, by a Spark aggregation of the classes.

Anchors, windows and contexts are compared by hashes of 62 bits (two moduli-prime
polynomials).

Defined results: null text counts as empty; texts under ``size`` bytes have no
window, so nothing is removed; rows with the same id and text are the same
document and get the same result (for ``keep="none"`` they are each other's
repeats); ids may be null or repeat with other texts; an empty table gives an
empty result; other columns pass through, input columns named like the outputs
are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb
from .util import maybe_flag, maybe_in, renamed, save

SEGMENT = 1 << 20       # bytes whose windows are looked at together
ORDERED = 2_000         # contexts whose suffixes are put in order together, or those of one anchor
CONTEXTS = 2_000        # contexts of one anchor that are put in order in one task
_POS = np.uint64(0xFFFFFF)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w consecutive ones (block-wise prefix and suffix minima)."""
    n = len(x)
    p = np.full(-(-n // w) * w, ~np.uint64(0))
    p[:n] = x
    p = p.reshape(-1, w)
    before = np.minimum.accumulate(p, axis=1).ravel()
    after = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - w + 1], before[w - 1:n])


def runs(buf: np.ndarray, offs: np.ndarray, size: int, gram: int):
    """(text number, first window, windows, anchor hash, context hash) of each run."""
    if len(buf) < size:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    h = tb.prefix(buf)
    s = np.arange(len(buf) - gram + 1)
    g = tb.span_hash(h, s, s + gram)
    least = _window_min((g & ~_POS) | s.astype(np.uint64), size - gram + 1)
    text = np.searchsorted(offs, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + size <= offs[text + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    stops = np.append(np.flatnonzero(new | ~inside), len(least))
    lo = np.flatnonzero(new & inside)
    hi = stops[np.searchsorted(stops, lo, "right")]
    anchor = g[(least[lo] & _POS).astype(np.int64)]
    t = text[lo]
    return t, lo - offs[t], hi - lo, anchor, tb.span_hash(h, lo, hi - 1 + size)


def _segments(col, size: int):
    """Slices, longer texts in overlapping segments: (row, shift, bytes, offsets)."""
    for first, buf, offs in tb.slices(col):
        if len(buf) <= SEGMENT:
            yield first, 0, buf, offs
        else:
            for a in range(0, max(1, len(buf) - size + 1), SEGMENT):
                part = buf[a:a + SEGMENT + size - 1]
                yield first, a, part, np.array([0, len(part)])


def _find_runs(size: int, gram: int):
    """One row a text and batch: its runs as arrays."""
    def run(batches):
        tb.begin()
        for b in batches:
            out: list = []
            for first, shift, buf, offs in _segments(b.column("_text"), size):
                t, lo, n, anchor, context = runs(buf, offs, size, gram)
                out.append((t + first, lo + shift, n, anchor, context))
            t, lo, n, anchor, context = (np.concatenate(x) for x in zip(*out)) if out else runs(np.empty(0, np.uint8), np.zeros(1, np.int64), size, gram)
            rows, at = np.unique(t, return_index=True)
            ends = pa.array(np.append(at, len(t)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in
                     (anchor.view(np.int64), context.view(np.int64), lo.astype(np.int32), n.astype(np.int32))]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column("_id").take(take), b.column("_th").take(take), *lists],
                                             ["_id", "_th", "anchor", "context", "lo", "n"])
    return run


def window_hashes(contexts, size: int):
    """(context number, window number, hash) of every window of each context."""
    buf, offs = tb.column(contexts)
    count = np.maximum(np.diff(offs) - size + 1, 0)
    c = np.repeat(np.arange(len(count)), count)
    w = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count)
    at = offs[c] + w
    return c, w, tb.span_hash(tb.prefix(buf), at, at + size)


def previous_factor(group: np.ndarray, prefix: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(has an earlier match, has a later match, the first match) of each suffix.

    Suffix order by (group, prefix); among suffixes with one prefix by position
    ``rank``, so the neighbour before is the previous smaller position and the
    neighbour after a larger one."""
    order = np.lexsort((rank, prefix, group))
    same = (group[order][1:] == group[order][:-1]) & (prefix[order][1:] == prefix[order][:-1])
    earlier, later, first = np.zeros(len(order), bool), np.zeros(len(order), bool), np.empty(len(order), np.int64)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    new = np.append(True, same == 0)[:len(order)]
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return earlier, later, first


def spans(c: np.ndarray, w: np.ndarray, skip: np.ndarray, marked: np.ndarray, contexts: int, size: int) -> pa.ListArray:
    """Bytes of the marked windows of each context, without the first ``skip`` of
    each window, as a flat list of [first, after last, ...]."""
    c, w, skip = c[marked], w[marked], skip[marked]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1] + 1) | (skip[1:] != skip[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(c)) - 1
    flat = np.empty(2 * len(first), np.int32)
    flat[::2], flat[1::2] = (w + skip)[first], (w[last] + size) if len(first) else []
    ends = np.searchsorted(c[first], np.arange(contexts + 1)) * 2
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _order_suffixes(size: int, keep: str):
    """Marked bytes of the first occurrence of each context; batches hold
    whole anchors only in sum, so rows of the last anchor are carried on."""
    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        c, w, h = window_hashes(t["bytes"], size)
        a, lo, text = (t[x].to_numpy() for x in ("anchor", "lo", "text"))
        # position of a suffix: its context's place in the corpus, then the window
        earlier, later, first = previous_factor(a[c], h, t["place"].to_numpy()[c].astype(np.int64) << 32 | w)
        marked, skip = (earlier, np.zeros(len(c), np.int64)) if keep == "first" else (earlier | later, np.zeros(len(c), np.int64))
        if keep == "first" and len(c):
            # what overlaps the first occurrence itself stays
            apart = lo[c] + w - (lo[c] + w)[first]
            skip = np.where((text[c] == text[c][first]) & (apart > 0) & (apart < size), size - apart, 0)
        return pa.RecordBatch.from_arrays([t["anchor"].combine_chunks(), t["context"].combine_chunks(), spans(c, w, skip, marked, len(t), size)],
                                          ["anchor", "context", "marked"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            a = t["anchor"].to_numpy()
            done, last = 0, int(np.searchsorted(a, a[-1])) if len(a) else 0      # sorted: the last anchor begins here
            while done < last:
                k = int(np.searchsorted(a, a[min(done + ORDERED, last)]))
                if k <= done:
                    k = int(np.searchsorted(a, a[done], "right"))
                yield solve(t.slice(done, k - done))
                done = k
            rest = t.slice(last)
        if rest is not None and len(rest):
            yield solve(rest)
    return run


def _hash_rows(size: int):
    def run(batches):
        for b in batches:
            c, w, h = window_hashes(b.column("bytes"), size)
            take = pa.array(c)
            yield pa.RecordBatch.from_arrays([b.column(x).take(take) for x in ("anchor", "context", "place")] + [pa.array(w.astype(np.int32)), pa.array(h.view(np.int64))],
                                             ["anchor", "context", "place", "w", "h"])
    return run


def _cut(size: int, whole_characters: bool):
    """Kept bytes, removed bytes and spans of each text, given its ranges."""
    def run(text: pa.Array, ranges: pa.Array) -> pa.Array:
        kept, gone, n_spans = [], [], []
        for raw, r in zip(text.to_pylist(), ranges.to_pylist()):
            if not r:
                kept.append(raw), gone.append(0), n_spans.append(0)
                continue
            r = sorted((r[i], r[i + 1]) for i in range(0, len(r), 2))
            out, at, removed, k = [], 0, 0, 0
            i = 0
            while i < len(r):
                a, b = r[i]
                while i < len(r) and r[i][0] <= b:
                    b = max(b, r[i][1])
                    i += 1
                if whole_characters:
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                if a < b:
                    out.append(raw[at:a])
                    removed, k, at = removed + b - a, k + 1, b
            out.append(raw[at:])
            kept.append(b"".join(out)), gone.append(removed), n_spans.append(k)
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(gone, pa.int64()), pa.array(n_spans, pa.int64())],
                                          ["kept", "n_removed", "n_spans"])
    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 400, keep: str = "first",
                   whole_characters: bool = False) -> DataFrame:
    """Remove every byte covered by a ``size``-byte string that also starts
    elsewhere: ``keep="first"`` elsewhere earlier (by id, then place in the
    text), apart from the bytes it shares with the first such string where the two
    overlap, so that what repeats without a gap keeps its first ``size`` bytes;
    ``keep="none"`` elsewhere at all. Adds kept (binary), n_removed and
    n_spans. ``whole_characters`` leaves characters whole that a span cuts."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    gram = max(8, size * 58 // 100)
    made = ("kept", "n_removed", "n_spans")
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = renamed(df, made)
    docs = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 62))).alias("_id"), raw.alias("_text"))
    docs = docs.withColumn("_th", F.xxhash64("_text"))
    big = docs.filter(F.octet_length("_text") >= size)
    found = save(big.mapInArrow(_find_runs(size, gram), "_id long, _th long, anchor array<long>, context array<long>, lo array<int>, n array<int>"))

    # anchors that occur more than once, and their runs
    again = save(found.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"))
    each = found.select("_id", "_th", F.explode(F.arrays_zip("anchor", "context", "lo", "n")).alias("r")).select("_id", "_th", "r.*")
    hits = save(maybe_in(each, F.col("anchor"), again, "anchor").join(again, "anchor"))
    contexts = save(hits.groupBy("anchor", "context").agg(F.count("*").alias("c"), F.min(F.struct("_id", "lo", "_th", "n")).alias("first")))
    per = contexts.groupBy("anchor").agg(F.count("*").alias("k"))
    several = per.filter("k > 1")

    # texts that hold a run of a repeated anchor
    near = maybe_in(big, F.col("_th"), hits, "_th")
    touched = save(near.join(hits.select("_id", "_th").distinct(), ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]))

    # one occurrence of each context of an anchor that has several
    ones = (contexts.join(several, "anchor").select("anchor", "context", "k", "first.*")
            .join(touched, ["_id", "_th"])
            .select("anchor", "context", "k", F.expr(f"substring(cast(_text as binary), lo + 1, n + {size - 1})").alias("bytes"),
                    F.struct("_id", "lo", "_th").alias("place")))
    ones = save(ones)
    place = "anchor long, context long, marked array<int>"
    ordered = (ones.filter(F.col("k") <= CONTEXTS)
               .select("anchor", "context", F.row_number().over(_by("anchor", "place")).alias("place"), F.col("place.lo").alias("lo"),
                       F.dense_rank().over(_by("anchor", "place._id", "place._th")).alias("text"), "bytes").mapInArrow(_order_suffixes(size, keep), place))
    hot = ones.filter(F.col("k") > CONTEXTS).select("anchor", "context", "place", "bytes")
    rows = hot.mapInArrow(_hash_rows(size), "anchor long, context long, place struct<_id: bigint, lo: int, _th: bigint>, w int, h long")
    classes = rows.groupBy("anchor", "h").agg(F.count("*").alias("m"), F.min(F.struct("place", "w")).alias("at")).filter("m > 1")
    mark, begin = rows.join(classes, ["anchor", "h"]), F.col("w")
    if keep == "first":
        mark = mark.filter(F.struct("place", "w") != F.col("at"))
        here, first = F.col("place.lo") + F.col("w"), F.col("at.place.lo") + F.col("at.w")
        over = (F.col("place._id") == F.col("at.place._id")) & (F.col("place._th") == F.col("at.place._th")) & (here - first < size)
        begin = F.when(over, F.col("w") + size - (here - first)).otherwise(begin)
    split = (mark.groupBy("anchor", "context").agg(F.sort_array(F.collect_set(F.array(begin.cast("int"), F.col("w") + size))).alias("ws"))
             .select("anchor", "context", F.flatten("ws").alias("marked")))
    marks = ordered.unionByName(split)

    # ranges of each text: its contexts' marks, or the whole run
    one = contexts.select("anchor", "context", "c", F.col("first._id").alias("f_id"), F.col("first._th").alias("f_th"), F.col("first.lo").alias("f_lo"))
    known = save(one.join(marks, ["anchor", "context"], "left"))
    end = F.col("n") + (size - 1)
    same = (F.col("_id") == F.col("f_id")) & (F.col("_th") == F.col("f_th")) & (F.col("lo") - F.col("f_lo") < size)
    whole = F.array(F.when(same, F.col("f_lo") + size - F.col("lo")).otherwise(0) if keep == "first" else F.lit(0), end)
    is_first = (F.col("_id") == F.col("f_id")) & (F.col("_th") == F.col("f_th")) & (F.col("lo") == F.col("f_lo"))
    settled = (F.col("c") == 1) | is_first if keep == "first" else F.col("c") == 1
    ranges = (hits.join(known, ["anchor", "context"])
              .select("_id", "_th", "lo", F.when(settled, F.coalesce("marked", F.array().cast("array<int>"))).otherwise(whole).alias("m"))
              .filter(F.size("m") > 0)
              .select("_id", "_th", F.expr("transform(m, x -> lo + x)").alias("m"))
              .groupBy("_id", "_th").agg(F.flatten(F.collect_list("m")).alias("_ranges")))
    ranges = save(ranges)

    # evaluated once a row, whatever is filtered by its result
    cut = F.arrow_udf(_cut(size, whole_characters), "kept binary, n_removed long, n_spans long").asNondeterministic()
    out = df.withColumns({"_id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 62))), "_th": F.xxhash64(raw)})
    keep_cols = [F.col(f"`{c}`") for c in df.columns]
    binary = raw.cast("binary")
    out = maybe_flag(out, F.col("_th"), ranges, "_th")
    hit = (out.filter("_maybe").join(ranges, ["_id", "_th"], "left").withColumn("_c", cut(binary, F.col("_ranges")))
           .select(*keep_cols, "_c.kept", "_c.n_removed", "_c.n_spans"))
    none = F.lit(0).cast("long")
    rest = out.filter("not _maybe").select(*keep_cols, binary.alias("kept"), none.alias("n_removed"), none.alias("n_spans"))
    return hit.unionByName(rest)


def strip_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 400) -> DataFrame:
    """The texts without later copies of passages (the first of each stays, also
    where later ones overlap it: of a repeated sign ``size`` bytes stay),
    characters left whole; rows of which nothing but white space is left go."""
    out = remove_repeats(df, id_col, text, size, "first", whole_characters=True)
    rest = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col(f"`{text}`"))
    out = out.withColumn("_rest", rest).filter("n_removed = 0 or length(trim(_rest)) > 0")
    return out.select(*[F.col("_rest").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def _by(part: str, *order: str):
    from pyspark.sql import Window
    return Window.partitionBy(part).orderBy(*order)
