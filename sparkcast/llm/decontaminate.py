"""Benchmark decontamination: BM25 over test items with block-max WAND.

The test items are indexed: every word's posting list holds (item, BM25
weight), in item order, in blocks of ``BLOCK`` items with the block's largest
weight. Weights are shares of the item's score for its own text, so one
threshold fits all items. Every training passage is a query: windows of
``2 * longest item`` words (``WINDOW`` at least) that overlap by half, so an
item's copy lies whole in one of them.

An item can only reach the threshold through its essential postings: its
commonest words, as long as they sum to under half the threshold, are set
aside as a fixed bound per item. A batch of passages is then solved as WAND
does it, for all passages together: block maxima of the essential lists plus
the block's largest set-aside bound rule out blocks; exact essential scores
plus the item's own bound rule out items; the others are scored in full.
Retrieved items are verified: at least ``OVERLAP`` of the 5-word shingles of
the item's question (to the first question mark, else line break) and of its
answer (the rest) must stand in the passage.

The index is built for shards of items of at most ``SHARD`` words, each a
broadcast of bounded size; word frequencies are those of all items.

Defined results: null or empty texts match nothing, items without words are
left out; a part of under five words is one shingle; repeated rows are
reported once, repeated item ids are one item per distinct text; empty tables
give an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textbytes as tb
from .util import maybe_flag, save

K1, B = 1.2, 0.75
THRESHOLD = 0.6         # share of the item's own score
OVERLAP = 0.8
WINDOW = 128            # words of a passage, at least
BLOCK = 16              # items
SHARD = 1_000_000       # words of the items indexed together
K = 5


def _words(texts: list[bytes]) -> list[np.ndarray]:
    buf, offs = tb.column(pa.array(texts, pa.binary()))
    w, t = tb.word_hashes(buf, offs, tb.PUNCTUATION)
    return np.split(w, np.searchsorted(t, np.arange(1, len(texts))))


def split_item(text: bytes) -> tuple[bytes, bytes]:
    """(question, answer): to the first question mark, else line break; a text
    without either is all question."""
    for mark in (b"?", b"\n"):
        a, m, b = text.strip().partition(mark)
        if m and b.strip():
            return a, b
    return text, b""


def _grams(w: np.ndarray, k: int = K) -> np.ndarray:
    return tb.shingles(w, np.zeros(len(w), np.int64), k)[0]


class Index:
    """Posting lists of a shard of items."""

    def __init__(self, ids: list[int], texts: list[bytes], df: dict[int, int], items: int, mean: float):
        every = _words(texts)
        self.ids = np.array(ids, np.int64)
        self.longest = max(len(w) for w in every)
        self.question, self.answer = (list(map(_grams_of, x)) for x in zip(*((_words([q])[0], _words([a])[0]) for q, a in map(split_item, texts))))
        item, word, weight, common = [], [], [], []
        for i, w in enumerate(every):
            u, tf = np.unique(w, return_counts=True)
            n = np.array([df[int(x)] for x in u], float)
            x = np.log(1 + (items - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            x /= x.sum()
            # commonest words first, set aside while they sum to under half the threshold
            order = np.lexsort((u, -n))
            aside = np.zeros(len(u), bool)
            aside[order] = np.cumsum(x[order]) < THRESHOLD / 2
            item.append(np.full(len(u), i)), word.append(u), weight.append(x), common.append(aside)
        item, word, weight, common = map(np.concatenate, (item, word, weight, common))
        self.bound = np.bincount(item, weights=weight * common, minlength=len(ids))
        self.vocabulary, number = np.unique(word, return_inverse=True)
        order = np.lexsort((item, number))
        self.item, self.weight, number, common = item[order], weight[order], number[order], common[order]
        self.start = np.searchsorted(number, np.arange(len(self.vocabulary) + 1))
        # essential lists and their blocks
        e = ~common
        self.e_item, self.e_weight = self.item[e], self.weight[e]
        self.e_start = np.searchsorted(number[e], np.arange(len(self.vocabulary) + 1))
        block = self.e_item // BLOCK
        key = number[e] * (len(ids) // BLOCK + 1) + block
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.b_block, self.b_number = block[first], number[e][first]
        self.b_max = np.maximum.reduceat(self.e_weight, first) if len(first) else np.empty(0)
        self.b_start = np.searchsorted(self.b_number, np.arange(len(self.vocabulary) + 1))
        self.block_bound = np.zeros(len(ids) // BLOCK + 1)
        np.maximum.at(self.block_bound, np.arange(len(ids)) // BLOCK, self.bound)
        self.essential = np.diff(self.e_start) > 0
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.vocabulary[self.essential] >> np.uint64(42)).astype(np.int64)] = True

    def find(self, w: np.ndarray, essential: bool) -> tuple[np.ndarray, np.ndarray]:
        """(places in w, word numbers) of the words that have a (essential) list."""
        at = np.flatnonzero(self.sieve[(w >> np.uint64(42)).astype(np.int64)]) if essential else np.arange(len(w))
        n = np.minimum(np.searchsorted(self.vocabulary, w[at]), len(self.vocabulary) - 1)
        ok = self.vocabulary[n] == w[at]
        if essential:
            ok &= self.essential[n]
        return at[ok], n[ok]


def _grams_of(w: np.ndarray) -> tuple[int, np.ndarray]:
    return min(K, len(w)), np.unique(_grams(w))


def _expand(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every entry of the lists n, whose bounds are in start."""
    size = start[n + 1] - start[n]
    row = np.repeat(np.arange(len(n)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + start[n][row]


def _sum_by(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(key, return_inverse=True)
    return u, np.bincount(inv, weights=x, minlength=len(u))


def retrieve(index: Index, w: np.ndarray, t: np.ndarray, window: int):
    """(first word of the passage, end, item, score) of all passages and items
    with a score of at least the threshold. w, t: words and their texts."""
    step = window // 2
    text_start = np.searchsorted(t, np.arange(t[-1] + 2)) if len(t) else np.zeros(1, np.int64)
    at, n = index.find(w, True)
    # a word at place p of its text stands in the passages p // step and the one before
    place = at - text_start[t[at]]
    first = np.cumsum(np.concatenate([[0], -(-np.diff(text_start) // step)]))     # passages before each text
    p = first[t[at]] + place // step
    again = place >= step
    p, n = np.concatenate([p, p[again] - 1]), np.concatenate([n, n[again]])
    size = len(index.vocabulary)
    pn = np.unique(p * size + n)
    p, n = pn // size, pn % size
    # blocks that may hold an item above the threshold
    blocks = len(index.block_bound)
    row, k = _expand(index.b_start, n)
    key, top = _sum_by(p[row] * blocks + index.b_block[k], index.b_max[k])
    alive = key[top + index.block_bound[key % blocks] >= THRESHOLD - 1e-9]
    # items of those blocks by their essential words
    maybe = np.isin(p, alive // blocks)
    p, n = p[maybe], n[maybe]
    row, k = _expand(index.e_start, n)
    ok = np.isin(p[row] * blocks + index.e_item[k] // BLOCK, alive)
    row, k = row[ok], k[ok]
    items = len(index.ids)
    key, part = _sum_by(p[row] * items + index.e_item[k], index.e_weight[k])
    key = key[part + index.bound[key % items] >= THRESHOLD - 1e-9]
    # full scores
    out = []
    for passage in np.unique(key // items):
        wanted = key[key // items == passage] % items if len(key) < 64 else key[np.searchsorted(key, passage * items):np.searchsorted(key, (passage + 1) * items)] % items
        text = np.searchsorted(first, passage, "right") - 1
        lo = text_start[text] + (passage - first[text]) * step
        hi = min(lo + window, text_start[text + 1])
        _, own = index.find(np.unique(w[lo:hi]), False)
        row, k = _expand(index.start, own)
        score = np.bincount(index.item[k], weights=index.weight[k], minlength=items)
        out += [(lo, hi, int(i), float(score[i])) for i in wanted if score[i] >= THRESHOLD]
    return out


def _overlap(grams: dict[int, np.ndarray], w: np.ndarray, part: tuple[int, np.ndarray]) -> float:
    k, want = part
    if not len(want):
        return 1.0
    if k not in grams:
        if k == K:
            g = _grams(w)
        else:                           # a part of under five words, as one shingle
            g = np.concatenate([_grams(w[i:i + k]) for i in range(len(w) - k + 1)]) if len(w) >= k else np.empty(0, np.uint64)
        grams[k] = g
    return float(np.isin(want, grams[k]).mean())


def _search(shared, window: int):
    def run(batches):
        tb.begin()
        index = shared.value
        for b in batches:
            rows, item, score, q, a = [], [], [], [], []
            for first, buf, offs in tb.slices(b.column("_text")):
                w, t = tb.word_hashes(buf, offs, tb.PUNCTUATION)
                best: dict = {}
                seen: dict = {}
                for lo, hi, i, s in retrieve(index, w, t, window):
                    grams = seen.setdefault(lo, {})
                    x, y = (_overlap(grams, w[lo:hi], part[i]) for part in (index.question, index.answer))
                    if x >= OVERLAP and y >= OVERLAP:
                        k = (first + int(t[lo]), i)
                        best[k] = max(best.get(k, (0, 0, 0)), (s, x, y))
                for (r, i), (s, x, y) in best.items():
                    rows.append(r), item.append(int(index.ids[i])), score.append(s), q.append(x), a.append(y)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_id").take(take), b.column("_th").take(take), pa.array(item, pa.int64()),
                                              pa.array(score, pa.float64()), pa.array(q, pa.float64()), pa.array(a, pa.float64())],
                                             ["_id", "_th", "item_id", "score", "question_overlap", "answer_overlap"])
    return run


def _item_words(batches):
    for b in batches:
        w = _words([x.encode() for x in b.column("_item").to_pylist()]) if b.num_rows else []
        yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("_item"), pa.array([len(x) for x in w], pa.int64()),
                                          pa.array([np.unique(x).view(np.int64).tolist() for x in w], pa.list_(pa.int64()))], ["item_id", "_item", "n", "words"])


def _indexes(items: DataFrame, id_col: str, text: str):
    """The index of each shard, one after the other on the driver."""
    items = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text).alias("_item")).filter("_item is not null").distinct()
    known = save(items.mapInArrow(_item_words, "item_id long, _item string, n long, words array<long>").filter("n > 0"))
    total = known.agg(F.count("*").alias("c"), F.sum("n").alias("s")).first()
    if not total["c"]:
        return
    df = known.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    before = F.sum("n").over(Window.orderBy("item_id", "_item").rowsBetween(Window.unboundedPreceding, -1))
    shards = 1 + (total["s"] - 1) // SHARD
    cut = known.withColumn("shard", F.lit(0) if shards == 1 else F.floor(F.coalesce(before, F.lit(0)) / SHARD))
    cut = save(cut)
    for k in range(shards):
        own = cut.filter(F.col("shard") == k)
        rows = own.select("item_id", "_item").orderBy("item_id", "_item").collect()
        if rows:
            n = own.select(F.explode("words").alias("word")).distinct().join(df, "word").collect()
            yield Index([r["item_id"] for r in rows], [r["_item"].encode() for r in rows],
                        {r["word"] & (1 << 64) - 1: r["df"] for r in n}, total["c"], total["s"] / total["c"])


def _matches(docs: DataFrame, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    schema = "_id long, _th long, item_id long, score double, question_overlap double, answer_overlap double"
    # no rows; made of a Python list, each executor would keep Python workers of another kind for it
    found = docs.sparkSession.range(0).select(F.from_json(F.lit(None).cast("string"), schema).alias("m")).select("m.*")
    for index in _indexes(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        part = docs.mapInArrow(_search(shared, 2 * max(WINDOW // 2, index.longest)), schema)
        found = found.unionByName(part)
    return found.groupBy("_id", "_th", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m")).select("_id", "_th", "item_id", "m.*")


def _keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.withColumns({"_id": F.col(f"`{id_col}`").cast("long"), "_th": F.xxhash64(raw), "_text": raw})


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap) of every document
    with a passage that holds a test item."""
    m = _matches(_keyed(docs, id_col, text).select("_id", "_th", "_text"), items, item_id, item_text)
    return (m.groupBy(F.col("_id").alias(id_col), "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m"))
            .select(id_col, "item_id", "m.*"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a passage that holds a test item, all columns."""
    keyed = _keyed(docs, id_col, text)
    bad = save(_matches(keyed.select("_id", "_th", "_text"), items, item_id, item_text).select("_id", "_th").distinct())
    flagged = maybe_flag(keyed.drop("_text"), F.col("_th"), bad, "_th")
    bad = bad.select(F.col("_id").alias("_b"), F.col("_th").alias("_t"))
    kept = flagged.filter("_maybe").join(bad, F.expr("_id <=> _b and _th = _t"), "left_anti")
    return flagged.filter("not _maybe").unionByName(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
