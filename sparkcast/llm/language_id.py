"""Language identification by error-correcting output codes.

Every language gets a binary codeword; one binary classifier per bit predicts
from byte n-grams on which side of the bit a text's language lies. A
classifier is a weight table over hashed 1-, 2- and 3-grams of lower-cased
bytes: the log odds of an n-gram between the languages with bit 1 and those
with bit 0, languages weighing the same. The tables come from n-gram counts
over all training rows, summed by Spark.

A text's margin on a bit is its mean weight, over the margin's standard error.
Decoding is loss-weighted: the codeword of least total logistic loss over the
margins wins, so a bit the classifier is sure of counts for more than one it
isn't. A text is ambiguous when the runner-up's probability is within
``AMBIGUOUS`` of the winner's.

Defined results: null text, or no letter in it: ``und``, score 0; no training
rows: every text ``und``; one language: always that one, score 1; repeated rows
and ids keep their rows; an empty table gives an empty result; other columns
pass through, input columns named like the outputs are replaced. Training rows
with null text or language are left out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textbytes as tb
from .util import renamed

BITS = 14               # log2 of the n-gram table
AMBIGUOUS = 0.2
UNKNOWN = "und"
_SIZE = 1 << BITS


def _codes(buf: np.ndarray, offs: np.ndarray):
    """(text number's first position per order) n-gram numbers of every position,
    for n = 1, 2, 3; -1 where the n-gram leaves the text."""
    low = tb.lower(buf).astype(np.uint32)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(low))     # bytes to the end of the text
    g = low
    yield g * np.uint32(2654435761) >> np.uint32(32 - BITS)
    for n in (2, 3):
        nxt = np.zeros(len(low), np.uint32)
        nxt[:-(n - 1)] = low[n - 1:]
        g = g << np.uint32(8) | nxt
        c = (g + np.uint32(n << 24)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        c = c.astype(np.int32)
        c[left < n] = -1
        yield c


def _count(batches):
    """(language, n-gram number, count) of a partition."""
    tb.begin()
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs = np.array(b.column("_lang").to_pylist(), object)
        for first, buf, offs in tb.slices(b.column("_text")):
            own = langs[first:first + len(offs) - 1]
            names, of = np.unique(own.astype(str), return_inverse=True)
            pos = np.repeat(of, np.diff(offs)).astype(np.int64) * _SIZE
            n = np.zeros(len(names) * _SIZE, np.int64)
            for c in _codes(buf, offs):
                ok = c.astype(np.int64) >= 0
                n += np.bincount((pos + c)[ok], minlength=len(n))
            for i, name in enumerate(names.tolist()):
                part = n[i * _SIZE:(i + 1) * _SIZE]
                total[name] = total[name] + part if name in total else part
    for name, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "count"])


def codewords(languages: int) -> np.ndarray:
    """One row of bits a language. Up to seven: every split into two sides;
    more: random splits (fixed seed), the best-separated of several draws."""
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= 7:
        rows = [(1, *x) for x in itertools.product((0, 1), repeat=languages - 1) if 0 in x]
        return np.array(rows, np.int8).T
    rng, best, apart = np.random.default_rng(7), None, -1
    for _ in range(200):
        c = rng.integers(0, 2, (languages, int(np.ceil(10 * np.log2(languages)))), dtype=np.int8)
        c = c[:, (c.min(0) == 0) & (c.max(0) == 1)]
        d = min((c[i] != c[j]).sum() for i in range(languages) for j in range(i))
        if d > apart:
            best, apart = c, d
    return best


class Model:
    """languages, codewords and, per n-gram, its weight on every bit."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        self.weights = np.zeros((_SIZE + 1, self.code.shape[1]), np.float32)    # last row: no n-gram
        self.spread = np.ones(self.code.shape[1])
        if self.code.shape[1]:
            p = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
            for j, bit in enumerate(self.code.T):
                w = np.log(p[bit == 1].mean(0)) - np.log(p[bit == 0].mean(0))
                self.weights[:-1, j] = w
                self.spread[j] = max(1e-3, np.sqrt((p.mean(0) * w * w).sum()))

    def margins(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Per text and bit: mean weight over its standard error, bounded."""
        texts, bits = len(offs) - 1, len(self.spread)
        s, n = np.zeros((texts, bits)), np.zeros(texts)
        full = np.flatnonzero(np.diff(offs))
        for c in _codes(buf, offs):
            none = c.astype(np.int64) < 0
            n += np.diff(np.concatenate([[0], np.cumsum(~none)])[offs])
            if len(full):
                s[full] += np.add.reduceat(self.weights.take(np.where(none, _SIZE, c), axis=0), offs[full], axis=0)
        n = np.maximum(n, 1)[:, None]
        # overlapping n-grams repeat what one byte says: three per position
        error = self.spread / np.sqrt(np.maximum(n / 3, 1)) + 0.05
        return np.clip(s / n / error, -12, 12)

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of each text."""
        texts = len(offs) - 1
        if len(self.languages) < 2:
            return np.zeros(texts, np.int64), np.ones(texts), np.zeros(texts, bool)
        m = self.margins(buf, offs)
        sign = 2.0 * self.code - 1
        loss = np.logaddexp(0, -m[:, None, :] * sign[None]).sum(2)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        return best, top[:, -1], top[:, -1] - top[:, -2] < AMBIGUOUS


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows with a text and a language. What reaches the driver
    are counts: at most 2**14 rows a language."""
    got = (rows.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
           .select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
           .mapInArrow(_count, "lang string, gram int, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count")).toPandas())
    languages = sorted(got["lang"].unique().tolist())
    counts = np.zeros((len(languages), _SIZE))
    if len(got):
        counts[np.searchsorted(np.array(languages, object), got["lang"].to_numpy()), got["gram"].to_numpy()] = got["count"].to_numpy()
    return Model(languages, counts)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous to every row."""
    made = ("lang_pred", "score", "ambiguous")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c == text or c not in made])
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def classify(t: pa.Array) -> pa.Array:
        m, best, score, close = shared.value, [], [], []
        for _, buf, offs in tb.slices(t):
            a, b, c = m.predict(buf, offs)
            best.append(a), score.append(b), close.append(c)
        cat = lambda x: np.concatenate(x) if x else np.empty(0)
        names = pa.array(m.languages or [UNKNOWN], pa.string())
        return pa.StructArray.from_arrays([names.take(pa.array(cat(best).astype(np.int64))), pa.array(cat(score).astype(float)), pa.array(cat(close).astype(bool))],
                                          ["lang_pred", "score", "ambiguous"])

    keep = [F.col(f"`{c}`") for c in df.columns if c not in made]
    raw: Column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    known = raw.rlike(r"\p{L}") & F.lit(bool(model.languages))
    # evaluated once a row: a filter on the result would bring a second copy into its tasks, and with it more Python workers
    once = classify.asNondeterministic()
    return (df.withColumns({"_m": once(raw), "_known": known})
            .select(*keep, F.when(F.col("_known"), F.col("_m.lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
                    F.when(F.col("_known"), F.col("_m.score")).otherwise(F.lit(0.0)).alias("score"),
                    (~F.col("_known") | F.col("_m.ambiguous")).alias("ambiguous")))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Rows whose crc32 of the id as text leaves remainder ``part``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def keep_identified(df: DataFrame, text: str = "text", lang: str = "lang", enough: int = 200) -> DataFrame:
    """The rows whose language is told: rows without a letter go, and rows of
    ``enough`` bytes or more that are ambiguous all the same (shorter ones say
    too little to be rejected). A missing language is filled in."""
    columns = df.columns
    found = identify(df, train(df, text, lang), text)
    names = {c for c in ("lang_pred", "score", "ambiguous") if c in columns}
    if names:
        raise ValueError(f"columns {sorted(names)} would be replaced")
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & ~(F.col("ambiguous") & (F.octet_length(F.col(f"`{text}`")) >= enough)))
    return kept.select(*[F.coalesce(F.col(f"`{c}`"), F.col("lang_pred")).alias(c) if c == lang else F.col(f"`{c}`") for c in columns])
