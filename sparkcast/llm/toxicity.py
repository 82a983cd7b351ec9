"""Toxicity by multiple-instance learning.

Only documents are labelled, but sentences offend. A sentence's probability is
a logistic function of the word features in it; a document's is their noisy-or,
``1 - prod(1 - p)``: one offending sentence is enough. Both are fitted from
document labels by gradient ascent on the noisy-or likelihood, after which the
sentence scores tell where a text offends.

Features are hashed words and word beginnings (4 to 8 bytes) of lower-cased
text (A-Z and the Latin letters of two bytes). Of all features those are kept
that stand in documents labelled 1 clearly more often than in others.

The classifier is fitted on a bounded sample: ``POSITIVE`` and ``NEGATIVE``
labelled rows at most, those of least hash of the id. Only the sample's counts
and the kept features of its documents reach the driver; scoring reads every
whole text in place.

Defined results: null or empty texts have no sentence and get the score of an
empty one; without labelled rows of both kinds every score is near 0; rows that
repeat in the training data count as often as they occur; an id with several
labels counts as 1 if any is; null labels and ids are left out of training; an
empty table gives an empty result; other columns pass through, input columns
named like the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb

POSITIVE, NEGATIVE = 6_000, 12_000
BITS = 21               # log2 of the feature table
KEPT = 4_000            # features
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
OFFENDS = 0.5           # of a sentence
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def _lower(buf: np.ndarray) -> np.ndarray:
    low = tb.lower(buf)
    two = np.zeros(len(low), bool)
    two[1:] = low[:-1] == 0xC3
    two &= (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
    low[two] += 0x20
    return low


def _features(buf: np.ndarray, offs: np.ndarray):
    """(sentence of each word, words' texts, feature hashes per kind with the
    words that have them, sentence starts, sentences' texts)."""
    low = _lower(buf)
    s, e, t = tb.words(low, offs, tb.PUNCTUATION)
    # a sentence begins at a text's start and after an end mark
    begin = np.zeros(len(low) + 1, bool)
    begin[1:] = _END[low]
    begin[offs] = True
    starts = np.flatnonzero(begin[:len(low)])
    sentence = np.searchsorted(starts, s, "right") - 1
    h = tb.prefix(low)
    kinds = [(np.arange(len(s)), tb.span_hash(h, s, e))]
    for k in PREFIXES:
        w = np.flatnonzero(e - s > k)
        kinds.append((w, tb.mix(tb.span_hash(h, s[w], s[w] + k) + np.uint64(k))))
    return sentence, t, kinds, starts, np.searchsorted(offs, starts, "right") - 1


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _count(batches):
    """Documents with each feature, by label: one compressed row a task."""
    import zstandard
    n = np.zeros((2, 1 << BITS), np.int32)
    docs = np.zeros(2, np.int64)
    for b in batches:
        label = b.column("_y").to_numpy(zero_copy_only=False).astype(np.int64)
        np.add.at(docs, label, 1)
        for first, buf, offs in tb.slices(b.column("_text")):
            _, t, kinds, _, _ = _features(buf, offs)
            at = np.unique(np.concatenate([(t[w] << BITS) | _bucket(h) for w, h in kinds]))
            np.add.at(n, (label[first + (at >> BITS)], at & ((1 << BITS) - 1)), 1)
    z = zstandard.ZstdCompressor(level=1)
    yield pa.RecordBatch.from_arrays([pa.array([docs[0]]), pa.array([docs[1]]), pa.array([z.compress(np.ascontiguousarray(n.view(np.uint8).reshape(-1, 4).T).tobytes())], pa.binary())],
                                     ["negative", "positive", "counts"])


def _kept_features(shared):
    """Per document: its sentences and the kept features as sentence, feature, sentence, ..."""
    def run(batches):
        kept = shared.value
        for b in batches:
            total, lists = [], []
            for _, buf, offs in tb.slices(b.column("_text")):
                sentence, t, kinds, starts, of = _features(buf, offs)
                first = np.searchsorted(of, np.arange(len(offs)))
                total += np.diff(first).tolist()
                rows = [(t[w][ok], sentence[w][ok], f[ok]) for w, h in kinds for f, ok in [_look_up(kept, h)]]
                t2, s2, f2 = (np.concatenate(x) for x in zip(*rows))
                order = np.lexsort((f2, s2, t2))
                t2, s2, f2 = t2[order], s2[order], f2[order]
                for i in range(len(offs) - 1):
                    lo, hi = np.searchsorted(t2, (i, i + 1))
                    lists.append(np.stack([s2[lo:hi] - first[i], f2[lo:hi]], 1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column("_y").cast(pa.int32()), pa.array(total, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["y", "sentences", "at"])
    return run


def _look_up(kept: np.ndarray, h: np.ndarray):
    """(feature number, whether it is kept) of each hash; kept: number per bucket or -1."""
    f = kept[_bucket(h)]
    return f, f >= 0


class Model:
    """kept: feature number of each bucket (-1: none); weights and bias of a sentence."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float):
        self.kept, self.weights, self.bias = kept, weights, bias

    def sentences(self, buf: np.ndarray, offs: np.ndarray):
        """(logit, start, text number) of each sentence."""
        sentence, _, kinds, starts, of = _features(buf, offs)
        z = np.full(len(starts), self.bias)
        for w, h in kinds:
            f, ok = _look_up(self.kept, h)
            z += np.bincount(sentence[w][ok], weights=self.weights[f[ok]], minlength=len(z))
        return z, starts, of


def _logistic(z):
    return np.exp(-np.logaddexp(0, -z))


def fit(y: np.ndarray, sentences: np.ndarray, doc: np.ndarray, sent: np.ndarray, feature: np.ndarray, features: int,
        steps: int = 400, rate: float = 0.1, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) that maximise the noisy-or likelihood (Adam, fixed start).

    doc, sent, feature: one entry per kept feature occurrence; sentences
    without any count through their number."""
    key, inv = np.unique(np.stack([doc, sent], 1), axis=0, return_inverse=True) if len(doc) else (np.empty((0, 2), np.int64), np.empty(0, np.int64))
    inv = inv.ravel()
    owner = key[:, 0]
    bare = sentences - np.bincount(owner, minlength=len(y))
    weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum())) ** 0.5 / max(1, len(y))
    x = np.zeros(features + 1)
    x[:features], x[-1] = 0.5, -6.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        z = x[-1] + np.bincount(inv, weights=x[feature], minlength=len(key))
        # log of the chance that no sentence offends
        none = -np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(y)) - bare * np.logaddexp(0, x[-1])
        p = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        # d loss / d none: label 1 gains from (1 - p) / p, label 0 loses 1
        g = np.where(y == 1, (1 - p) / p, -1.0) * weight
        s = -g[owner] * _logistic(z)
        grad = np.zeros_like(x)
        grad[:features] = np.bincount(feature, weights=s[inv], minlength=features) + decay * x[:features] / max(1, features) ** 0.5
        grad[-1] = s.sum() - (g * bare).sum() * _logistic(x[-1])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-10)
    return x[:features], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
          positive: int = POSITIVE, negative: int = NEGATIVE) -> Model:
    """Fit on a bounded sample of the documents that ``labels`` (id, label) marks."""
    import zstandard
    spark = docs.sparkSession
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label) == 1).cast("int")).alias("_y")))
    pick = F.xxhash64("_id")
    sample = (known.filter("_y = 1").orderBy(pick, "_id").limit(positive).unionByName(known.filter("_y = 0").orderBy(pick, "_id").limit(negative)))
    # at most positive + negative ids: a bounded broadcast, no text is shuffled
    rows = (docs.filter(F.col(id_col).isNotNull()).join(F.broadcast(sample), F.col(id_col) == F.col("_id"))
            .select("_y", F.coalesce(F.col(text), F.lit("")).alias("_text")))
    counts, n_docs = np.zeros((2, 1 << BITS), np.int64), np.zeros(2)
    z = zstandard.ZstdDecompressor()
    for r in rows.mapInArrow(_count, "negative long, positive long, counts binary").toLocalIterator():
        n_docs += (r["negative"], r["positive"])
        counts += np.ascontiguousarray(np.frombuffer(z.decompress(bytes(r["counts"])), np.uint8).reshape(4, -1).T).view(np.int32).reshape(2, -1)
    kept = np.full(1 << BITS, -1, np.int32)
    if not n_docs.all():
        return Model(kept, np.zeros(0), -12.0)
    rate = (counts + 0.5) / (n_docs[:, None] + 1)
    # how far the rate among label 1 lies above the other, in standard errors
    both = counts.sum(0) / n_docs.sum()
    apart = (counts[1] / n_docs[1] - counts[0] / n_docs[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n_docs).sum())
    good = np.flatnonzero((counts[1] >= 3) & (rate[1] > 3 * rate[0]) & (apart > 4))
    good = np.sort(good[np.lexsort((good, -apart[good]))][:KEPT])
    kept[good] = np.arange(len(good), dtype=np.int32)
    shared = spark.sparkContext.broadcast(kept)
    got = rows.mapInArrow(_kept_features(shared), "y int, sentences long, at array<long>").collect()
    pairs = [np.array(r["at"], np.int64).reshape(-1, 2) for r in got]
    doc = np.repeat(np.arange(len(got)), [len(p) for p in pairs])
    flat = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    weights, bias = fit(np.array([r["y"] for r in got]), np.array([r["sentences"] for r in got], float), doc, flat[:, 0], flat[:, 1], len(good))
    return Model(kept, weights, bias)


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1), predicted (1 from ``threshold`` on) and offending: the
    byte ranges and scores of sentences that offend by themselves."""
    made = ("score", "predicted", "offending")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c == text or c not in made])
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = "score double, offending array<struct<first:int,after:int,score:double>>"

    @F.arrow_udf(schema)
    def rate(t: pa.Array) -> pa.Array:
        m, scores, found = shared.value, [], []
        for _, buf, offs in tb.slices(t):
            z, starts, of = m.sentences(buf, offs)
            none = -np.bincount(of, weights=np.logaddexp(0, z), minlength=len(offs) - 1)
            none[np.diff(offs) == 0] = -np.logaddexp(0, m.bias)
            scores.append(-np.expm1(none))
            p = _logistic(z)
            after = np.append(starts[1:], len(buf))
            rows: list = [[] for _ in range(len(offs) - 1)]
            for i in np.flatnonzero(p >= OFFENDS).tolist():
                rows[of[i]].append({"first": int(starts[i] - offs[of[i]]), "after": int(after[i] - offs[of[i]]), "score": float(p[i])})
            found += rows
        kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else np.empty(0)), pa.array(found, kind)], ["score", "offending"])

    keep = [F.col(f"`{c}`") for c in df.columns if c not in made]
    out = df.withColumn("_r", rate(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return out.select(*keep, F.col("_r.score").alias("score"), (F.col("_r.score") >= threshold).cast("int").alias("predicted"), F.col("_r.offending").alias("offending"))
