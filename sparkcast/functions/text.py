"""Text functions: name normalisation (F1), word tokens (F12), fuzzy ratio
(F19), placeholder fill (F3/F4), file-safe labels (F17).

F1 is this module's only Python UDF: Unicode NFKD decomposition has no Spark
SQL equivalent. It is an Arrow UDF; callers apply it to distinct values where they can. Everything else here is JVM-side SQL.
"""

from __future__ import annotations

import re
import unicodedata
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

if TYPE_CHECKING:       # Python workers of F1 go without pandas
    import pandas as pd

SLICE = 1 << 20         # characters of texts that a Python worker holds as strings at a time
_BLANKS, _MARKS = re.compile(r"\s+"), re.compile(r"[^\w\s]")


def _ascii_fold(x: str) -> str:
    return x if x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii")


def _normalize(x: str | None, strip_punctuation: bool) -> str:
    t = _BLANKS.sub(" ", _ascii_fold(x or ""))
    if strip_punctuation:
        t = _MARKS.sub("", t)
    return t.strip().title()


def normalize_series(s: pd.Series, strip_punctuation: bool = False) -> pd.Series:
    """F1 on a pandas Series: null -> '', NFKD then drop non-ASCII, collapse
    whitespace runs to one space, optionally drop punctuation, trim, title."""
    return s.where(s.notna(), "").astype(str).map(lambda x: _normalize(x, strip_punctuation))


def normalize_array(col: pa.Array, strip_punctuation: bool = False) -> pa.Array:
    """F1 on an Arrow column, a value at a time: besides the column and its
    result, strings of about ``SLICE`` characters (or one text) are held."""
    done, part, size = [], [], 0
    for x in col:
        part.append(_normalize(x.as_py(), strip_punctuation))
        size += len(part[-1])
        if size > SLICE:
            done.append(pa.array(part, pa.string()))
            part, size = [], 0
    out = pa.concat_arrays([*done, pa.array(part, pa.string())])
    del done
    pa.default_memory_pool().release_unused()
    return out


@F.arrow_udf(StringType())
def _normalize_udf(s: pa.Array) -> pa.Array:
    return normalize_array(s, False)


@F.arrow_udf(StringType())
def _normalize_strip_udf(s: pa.Array) -> pa.Array:
    return normalize_array(s, True)


def normalize(col: Column | str, strip_punctuation: bool = False) -> Column:
    """F1 ``normalize(text, strip_punctuation=False)`` as a column."""
    col = F.col(col) if isinstance(col, str) else col
    return (_normalize_strip_udf if strip_punctuation else _normalize_udf)(col)


def word_tokens(col: Column | str) -> Column:
    """distinct words longer than 3 characters, punctuation removed,
    compared case-insensitively (title-case equality on ASCII is lower-case
    equality). Input is an already normalised name (single spaces)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array_distinct(F.transform(
        F.filter(F.split(col, " "), lambda w: F.length(w) > 3),
        lambda w: F.lower(F.trim(F.regexp_replace(w, r"[^A-Za-z0-9_\s]", "")))))


def ratio_process(col: Column | str) -> Column:
    """The fuzzy matcher's string preparation: non-alphanumerics (except _)
    to spaces, lower case, trim."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(F.trim(F.regexp_replace(col, r"[^A-Za-z0-9_]", " ")))


# Bit-parallel LCS length (one 64-bit word): strings up to 62 characters on
# the mask side; longer ones take several words (lcs_words).
MAX_BITS = 62


def _bit(j: Column) -> Column:
    """2^j as bigint (exact for j <= 62)."""
    return F.pow(F.lit(2.0), j).cast("long")


def char_masks(col: Column | str) -> Column:
    """map<char, bigint>: bit j set where the string has that char at j.
    Only the first 63 positions get bits (a 64-bit word); longer strings are
    scored by :func:`lcs_words`, which makes its own."""
    col = F.col(col) if isinstance(col, str) else col
    return F.map_from_entries(F.transform(
        F.array_distinct(F.split(col, "")),
        lambda ch: F.struct(ch.alias("k"), F.aggregate(
            F.sequence(F.lit(0), F.least(F.length(col) - 1, F.lit(MAX_BITS))), F.lit(0).cast("long"),
            lambda acc, j: acc.bitwiseOR(F.when(F.substring(col, j + 1, 1) == ch,
                                                _bit(j))
                                         .otherwise(F.lit(0).cast("long")))).alias("v"))))


def lcs_bits(a: Column, masks: Column, lb: Column) -> Column:
    """LCS length of ``a`` and a string of length ``lb`` (<= 62) given its
    :func:`char_masks`: U = V & M, V = ((V + U) | (V - U)) per char of ``a``;
    the answer is the number of cleared bits of V."""
    full = _bit(lb) - 1

    def step(v, ch):
        m = F.coalesce(F.try_element_at(masks, ch), F.lit(0).cast("long"))
        u = v.bitwiseAND(m)
        return ((v + u).bitwiseOR(v - u)).bitwiseAND(full)

    return lb - F.bit_count(F.aggregate(F.split(a, ""), full, step))


def char_codes(col: Column) -> Column:
    """array<int> of the string's character codes."""
    return F.transform(F.split(col, ""), lambda ch: F.ascii(ch))


def ascii_mask_array(masks: Column) -> Column:
    """The :func:`char_masks` map as a 128-slot array indexed by ASCII code."""
    return F.transform(F.sequence(F.lit(0), F.lit(127)),
                       lambda code: F.coalesce(F.try_element_at(masks, F.chr(code)), F.lit(0).cast("long")))


def lcs_bits_codes(codes: Column, mask_arr: Column, lb: Column) -> Column:
    """:func:`lcs_bits` for ASCII strings given as codes: an array index per
    character instead of a map look-up."""
    full = _bit(lb) - 1

    def step(v, code):
        m = F.coalesce(F.get(mask_arr, code), F.lit(0).cast("long"))
        u = v.bitwiseAND(m)
        return ((v + u).bitwiseOR(v - u)).bitwiseAND(full)

    return lb - F.bit_count(F.aggregate(codes, full, step))


def lcs_words(a: Column, b: Column) -> Column:
    """LCS length for a ``b`` of any length: the bits of :func:`lcs_bits` over
    several 62-bit words, the sum's carry handed on to the next word. The work
    is the length of ``a`` times the words of ``b``."""
    full = _bit(F.lit(MAX_BITS)) - 1
    zero = F.lit(0).cast("long")
    starts = F.sequence(F.lit(0), F.greatest(F.length(b) - 1, F.lit(0)), F.lit(MAX_BITS))
    parts = F.transform(starts, lambda k: F.substr(b, k + 1, F.lit(MAX_BITS)))
    fulls = F.transform(parts, lambda x: _bit(F.length(x)) - 1)
    masks = F.transform(parts, char_masks)

    def step(state, ch):
        def word(acc, i):
            v, f = F.get(state["v"], i), F.get(state["full"], i)
            u = v.bitwiseAND(F.coalesce(F.try_element_at(F.get(state["masks"], i), ch), zero))
            total = v + u + acc["carry"]
            return F.struct(F.concat(acc["out"], F.array(total.bitwiseOR(v - u).bitwiseAND(f))).alias("out"),
                            F.when(total > full, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("carry"))

        empty = F.struct(F.array().cast("array<bigint>").alias("out"), zero.alias("carry"))
        out = F.aggregate(F.sequence(F.lit(0), F.size(state["v"]) - 1), empty, word, lambda acc: acc["out"])
        return F.struct(out.alias("v"), state["full"].alias("full"), state["masks"].alias("masks"))

    # masks and full words ride in the state: as expressions they'd be made again for each character
    start = F.struct(fulls.alias("v"), fulls.alias("full"), masks.alias("masks"))
    return F.aggregate(F.split(a, ""), start, step, lambda s: F.length(b) - F.aggregate(s["v"], F.lit(0), lambda n, x: n + F.bit_count(x)))


def fuzzy_ratio(a: Column, b: Column, b_masks: Column | None = None) -> Column:
    """similarity 0-100 = round-half-even(100 * 2 * LCS / (|a| + |b|)) on
    already processed strings; equal strings score 100, an empty one 0."""
    la, lb = F.length(a), F.length(b)
    masks = b_masks if b_masks is not None else char_masks(b)
    lcs = F.when(lb <= MAX_BITS, lcs_bits(a, masks, lb)).otherwise(lcs_words(a, b))
    raw = F.lit(100.0) * ((F.lit(2) * lcs).cast("double") / (la + lb).cast("double"))
    return (F.when(a == b, F.lit(100))
            .when((la == 0) | (lb == 0), F.lit(0))
            .otherwise(F.bround(raw, 0).cast("int")))


def fill_placeholders(template: Column, mapping: dict[str, Column]) -> Column:
    """replace each ``[key]`` placeholder by its column value."""
    out = template
    for k, v in mapping.items():
        out = F.replace(out, F.lit(f"[{k}]"), v)
    return out


def list_placeholder(text: Column, items: Column, key: str = "all metrics") -> Column:
    """``[all metrics]`` -> the items joined with ', '."""
    return F.replace(text, F.lit(f"[{key}]"), F.array_join(items, ", "))


def file_label(col: Column | str) -> Column:
    """'/', ' ' and ':' -> '_'."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(col, "[/ :]", "_")
