"""Alignment of the tokens of two tokenizers over the same bytes.

Of a text, tokens and bytes make a sparse incidence matrix for each tokenizer
(row: token, column: byte). Row by row (Gustavson's algorithm) the product of
one with the transpose of the other gives the overlap links: an entry for each
pair of tokens that share bytes, whose value is how many. Offsets where tokens
of both end cut a text into groups; the product of the two token-group
incidence matrices gives the shared-group links. The matrices are held in
compressed sparse rows made here (``Csr``).

Both tokenizers of ``align`` have no token that goes beyond certain places: a
blank behind anything but white space, and another ASCII character than a letter
behind an ASCII letter (the second vocabulary is checked for it). Between two
such places lies a stretch. So a text's tokens, groups and links are those of its stretches, and
the products are made once for each distinct stretch a task meets (block
diagonal, many stretches a product). What is kept is bounded by bytes.

``align`` reads the texts twice: first for the corpus-wide count of every id
pair (summed in the task, then by Spark), then for each text's links against
those counts. Pairs are kept in a written table. Of them at most ``COMMON``, the
most frequent, are broadcast; links of others, rare ones, find their counts by a
join. The highest count of a B id is a table with a row for each B id.

Defined results: texts that are null, empty, or whose tokens' bytes joined
differ from a blank and the text have no tokens: zeros and ''. Strings of special tokens are
plain text. Repeated rows count as often as they come; an empty table gives an
empty result; columns named like the outputs are replaced, others pass through.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pretoken, textbytes as tb
from .util import save
from .wordids import gather, spans

COMMON = 1 << 19        # pairs that are broadcast: 8 MB
MADE = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


@dataclass
class Csr:
    """Compressed sparse rows: of row i the columns ``col[ptr[i]:ptr[i + 1]]``, ascending, and their values."""
    ptr: np.ndarray
    col: np.ndarray
    val: np.ndarray
    width: int

    def transposed(self) -> "Csr":
        order = np.argsort(self.col, kind="stable")
        ptr = np.concatenate([[0], np.cumsum(np.bincount(self.col, minlength=self.width))])
        return Csr(ptr, self.rows()[order], self.val[order], len(self.ptr) - 1)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def __matmul__(self, other: "Csr") -> "Csr":
        """Row i is the sum of the other's rows that row i names, each times its value."""
        reach, ends = gather(np.arange(len(other.col)), other.ptr, self.col)
        n = np.diff(ends)
        row, col, val = np.repeat(self.rows(), n), other.col[reach], np.repeat(self.val, n) * other.val[reach]
        key = row * other.width + col
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, val = key[order], val[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        key = key[first]
        ptr = np.searchsorted(key, np.arange(len(self.ptr)) * other.width)
        return Csr(ptr, key % max(other.width, 1), np.add.reduceat(val, first) if len(key) else val, other.width)


def byte_incidence(ends: np.ndarray, n_bytes: int) -> Csr:
    """Tokens that tile the bytes, from where each ends: row token, column byte."""
    return Csr(np.concatenate([[0], ends]), np.arange(n_bytes), np.ones(n_bytes, np.int64), n_bytes)


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray, n_bytes: int) -> Csr:
    """A (tokens by bytes) times B transposed: shared bytes of every linked pair."""
    return byte_incidence(a_ends, n_bytes) @ byte_incidence(b_ends, n_bytes).transposed()


def group_incidence(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[Csr, Csr, np.ndarray]:
    """(A by groups, B by groups, where groups end): groups end where tokens of both end."""
    cut = np.intersect1d(a_ends, b_ends, assume_unique=True)
    of = lambda ends: Csr(np.arange(len(ends) + 1), np.searchsorted(cut, ends), np.ones(len(ends), np.int64), len(cut))
    return of(a_ends), of(b_ends), cut


def group_links(a_ends: np.ndarray, b_ends: np.ndarray) -> Csr:
    """A by groups times B by groups transposed: a one for each pair of tokens of one group."""
    a, b, _ = group_incidence(a_ends, b_ends)
    return a @ b.transposed()


_aligners: dict[tuple, "Aligner"] = {}
tb.kept.append(_aligners)


class Aligner:
    """Tokens, groups and links of distinct stretches; one per process and pair of files."""

    def __init__(self, a_path: str, b_path: str, groups: bool = True, limit: int = 128 << 20):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = _bytes_of(token)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        beyond = re.compile(r"[^▁]▁|[A-Za-z][\x00-@\[-`{-\x7f]")
        if any(beyond.search(self.b.id_to_piece(i)) for i in range(len(self.b_bytes)) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))):
            raise ValueError("the second vocabulary has pieces that go on where texts are taken apart")
        self.groups, self.limit = groups, limit                             # groups: asked for beside links
        self.reset()

    @staticmethod
    def of(*what) -> "Aligner":
        if what not in _aligners:
            _aligners.clear()
            _aligners[what] = Aligner(*what)
        return _aligners[what]

    def reset(self):
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.text: list[str] = []                                           # the groups of a stretch as the contract writes them
        self.ok = np.empty(0, bool)
        self.stat = np.empty((0, 5), np.int64)                              # n_a, n_b, n_groups, n_links, links within groups
        self.pair, self.times, self.at = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)

    def _tokens(self, stretches: list[bytes]):
        """(order, for A and for B all ids in that order and how many each stretch
        has, whether both keep its bytes): many stretches a call of the libraries."""
        words = [s.decode() for s in stretches]
        # those that begin with a blank and end with none stand behind one another as in a text
        chain = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[-1].isspace() and "▁" not in w]
        order, ids, size = [], ([], []), ([], [])
        for lo in range(0, len(chain), 1000):
            part = chain[lo:lo + 1000]
            joined = "".join([words[i] for i in part])
            raw, edge, found = joined.encode(), np.cumsum([len(stretches[i]) for i in part]), []
            for got, sizes, of in ((self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.a_len, self.a_bytes), (self.b.encode(joined[1:]), self.b_len, self.b_bytes)):
                x = np.array(got, np.int64)
                ends = np.cumsum(sizes[x])
                at = np.minimum(np.searchsorted(ends, edge), len(ends) - 1)
                if not (ends[at] == edge).all() or b"".join(map(of.__getitem__, got)) != raw:
                    break                                                   # one of them isn't kept: each by itself
                found.append((x, np.diff(at, prepend=-1)))
            else:
                order += part
                for k in (0, 1):
                    ids[k].append(found[k][0])
                    size[k].append(found[k][1])
        done = set(order)
        left = [i for i in range(len(words)) if i not in done]
        ok = np.ones(len(words), bool)
        blank = len(self.b.encode("a"))
        for i, x in zip(left, self.a.encode_batch_fast([words[i] for i in left], add_special_tokens=False)):
            # B puts a blank before a text, but none before an empty one; other stretches follow a letter
            w = words[i]
            both = x.ids, self.b.encode(w[1:]) if len(w) > 1 and w[0] == " " else self.b.encode("a" + w)[blank:]
            ok[len(order)] = all(b"".join(map(of.__getitem__, y)) == stretches[i] for y, of in zip(both, (self.a_bytes, self.b_bytes)))
            for k in (0, 1):
                y = both[k] if ok[len(order)] else []
                ids[k].append(np.array(y, np.int64))
                size[k].append(np.array([len(y)], np.int64))
            order.append(i)
        none = np.empty(0, np.int64)
        return order, *((np.concatenate([none, *ids[k]]), np.concatenate([none, *size[k]])) for k in (0, 1)), ok

    def _add(self, stretches: list[bytes]):
        order, (a, a_size), (b, b_size), ok = self._tokens(stretches)
        stretches = [stretches[i] for i in order]
        n = len(stretches)
        # many stretches side by side: block-diagonal matrices over their joined bytes
        size = np.where(ok, np.fromiter(map(len, stretches), np.int64, n), 0)
        edge, total = np.cumsum(size), int(size.sum())
        ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        links = overlap_links(*ends, total)
        na = np.concatenate([[0], np.cumsum(a_size)])
        row = links.rows()
        of = np.searchsorted(na, row, "right") - 1                          # stretch of each link
        pair = a[row] << 32 | b[links.col]
        key = np.lexsort((pair, of))
        p, o = pair[key], of[key]
        first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (p[1:] != p[:-1])]) if len(p) else np.empty(0, np.int64)
        self.pair = np.concatenate([self.pair, p[first]])
        self.times = np.concatenate([self.times, np.diff(np.append(first, len(p)))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(o[first], minlength=n))])
        self.known.update(zip(stretches, range(len(self.ok), len(self.ok) + n)))
        self.ok = np.concatenate([self.ok, ok])
        self.size += int(sum(map(len, stretches))) + 200 * n + 16 * len(first)
        if self.groups:
            self._add_groups(a, b, ends, na, edge, np.diff(links.ptr[na]), b_size)

    def _add_groups(self, a, b, ends, na, edge, n_links, b_size):
        """Counts of groups and the groups of each stretch, written as ``a1,a2|b1;a3|b2``."""
        in_a, in_b, cut = group_incidence(*ends)
        b_of_group = np.diff(in_b.transposed().ptr)
        within = np.concatenate([[0], np.cumsum(b_of_group[in_a.col])])     # entries of each row of the product
        groups = np.concatenate([[0], np.searchsorted(cut, edge, "right")])
        stat = np.stack([np.diff(na), b_size, np.diff(groups), n_links, np.diff(within[na])], axis=1)
        a_s, b_s = list(map(str, a.tolist())), list(map(str, b.tolist()))
        one, i, j = [], 0, 0
        for x, y in zip(np.cumsum(np.bincount(in_a.col, minlength=len(cut))).tolist(), np.cumsum(b_of_group).tolist()):
            if x == i + 1 and y == j + 1:
                one.append(f"{a_s[i]}|{b_s[j]}")
            else:
                one.append(",".join(a_s[i:x]) + "|" + ",".join(b_s[j:y]))
            i, j = x, y
        g = groups.tolist()
        text = [";".join(one[x:y]) for x, y in zip(g, g[1:])]
        self.text += text
        self.stat = np.concatenate([self.stat, stat])
        self.size += sum(map(len, text)) + 100 * len(text)

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        if self.size > self.limit:
            self.reset()
        d = pieces.dictionary_encode()
        words = d.dictionary.to_pylist()
        known = self.known
        n = [known.get(w, -1) for w in words]
        new = [w for w, i in zip(words, n) if i < 0]
        if new:
            self._add(new)
            n = [known[w] if i < 0 else i for w, i in zip(words, n)]
        return np.array(n, np.int64)[d.indices.to_numpy(zero_copy_only=False)]

    def texts(self, col):
        """(first row, number of each stretch, where each text's stretches begin, texts that have tokens), a slice at a time."""
        for first, buf, offs in tb.slices(_blank_before(col), (1 << 20) - 1):
            st = stretch_starts(buf, offs)
            n = self.numbers(spans(buf, st))
            at = np.searchsorted(st, offs)
            good = np.concatenate([[0], np.cumsum(self.ok[n])])
            fine = np.diff(good[at]) == np.diff(at)
            fine &= np.diff(offs) > 1                                       # not the blank alone
            yield first, n, at, fine


def _bytes_of(token: str) -> bytes:
    """Bytes that a byte-level vocabulary entry stands for: printable bytes stand
    for themselves, the others, in order, for the characters from 256 on."""
    try:
        return bytes(_BYTE_OF[c] for c in token)
    except KeyError:
        return token.encode()


_printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_printable))}


def _blank_before(col) -> pa.Array:
    """The texts with a blank before each."""
    buf, offs = tb.column(col)
    out = np.empty(len(buf) + len(offs) - 1, np.uint8)
    at = offs[:-1] + np.arange(len(offs) - 1)
    mask = np.ones(len(out), bool)
    mask[at] = False
    out[at], out[mask] = 0x20, buf
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs + np.arange(len(offs))), pa.py_buffer(out)])


def stretch_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where texts begin, blanks behind what isn't white space, and other ASCII
    characters than letters behind ASCII letters."""
    cut = np.zeros(len(buf) + 1, bool)
    letter = _LETTER[buf]
    cut[1:-1] = letter[:-1] & ~letter[1:] & (buf[1:] < 0x80)
    blank = np.flatnonzero(buf == 0x20)
    blank = blank[blank > 0]
    b = buf.astype(np.int64)
    one, two, three = b[blank - 1], b[np.maximum(blank - 2, 0)], b[np.maximum(blank - 3, 0)]
    white = tb.WHITE[one] | np.isin(two << 8 | one, _WIDE_WHITE) | np.isin(three << 16 | two << 8 | one, _WIDE_WHITE)
    cut[blank[~white]] = True
    cut[offs] = True
    return np.flatnonzero(cut[:-1])


_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_WIDE_WHITE = np.array(sorted(int.from_bytes(chr(c).encode()) for c in pretoken._WHITE if c >= 0x80), np.int64)     # two or three bytes


def _count_pairs(a: str, b: str, text: str):
    def run(batches):
        aligner = Aligner.of(a, b, False)
        pair, times = np.empty(0, np.int64), np.empty(0, np.int64)

        def merged(p, t):
            p, inv = np.unique(np.concatenate([pair, p]), return_inverse=True)
            return p, np.bincount(inv, weights=np.concatenate([times, t])).astype(np.int64)

        out = lambda: pa.RecordBatch.from_arrays([pa.array(pair), pa.array(times)], ["pair", "n"])
        for batch in batches:
            for _, n, at, fine in aligner.texts(batch.column(text)):
                n = n[np.repeat(fine, np.diff(at))]
                known, often = np.unique(n, return_counts=True)
                p, ends = gather(aligner.pair, aligner.at, known)
                t, _ = gather(aligner.times, aligner.at, known)
                pair, times = merged(p, t * np.repeat(often, np.diff(ends)))
                if len(pair) > 1 << 19:
                    yield out()
                    pair, times = pair[:0], times[:0]
        if len(pair):
            yield out()
    return run


def pair_counts(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """(pair, n, best): links of each id pair (A id << 32 | B id) over all texts,
    and whether no other pair of its B id has more. Written to the shared folder."""
    got = (docs.select(F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL").mapInArrow(_count_pairs(a, b, "text"), "pair long, n long")
           .groupBy("pair").agg(F.sum("n").alias("n")))
    got = save(got.withColumn("b", F.expr("pair & 4294967295")))
    top = got.groupBy("b").agg(F.max("n").alias("top"))                     # at most a row for each id of B
    return save(got.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def _common(pairs: DataFrame, most: int):
    """(sorted pairs, counts, best) of the most frequent pairs, at most ``most``; whether that is all."""
    bits = F.floor(F.log2(F.col("n"))).cast("int")
    kept, floor, rows = 0, None, 0
    for r in sorted(pairs.groupBy(bits.alias("bits")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.bits):    # at most 63 rows
        rows += r.k
        if rows <= most:
            kept, floor = rows, r.bits
    if floor is None:
        return None, not rows
    t = pairs.filter(bits >= floor).select("pair", "n", "best").toArrow().combine_chunks().sort_by("pair")
    return tuple(t[c].to_numpy() for c in ("pair", "n", "best")), kept == rows


def _score(a: str, b: str, text: str, common, schema: pa.Schema):
    def run(batches):
        aligner = Aligner.of(a, b, True)
        p_all, n_all, best_all = common.value if common else (np.empty(0, np.int64),) * 3
        for batch in batches:
            made, rest = [], []
            digest = []
            for _, n, at, fine in aligner.texts(batch.column(text)):
                known, inv = np.unique(n, return_inverse=True)
                p, ends = gather(aligner.pair, aligner.at, known)
                t, _ = gather(aligner.times, aligner.at, known)
                where = np.minimum(np.searchsorted(p_all, p), max(len(p_all) - 1, 0))
                hit = p_all[where] == p if len(p_all) else np.zeros(len(p), bool)
                count = np.where(hit, n_all[where], 0) if len(p_all) else np.zeros(len(p), np.int64)
                best = np.where(hit, best_all[where], False) if len(p_all) else hit
                owner = np.repeat(np.arange(len(known)), np.diff(ends))
                per = np.zeros((len(known), 7), np.int64)
                per[:, :5] = aligner.stat[known]
                for k, x in ((5, t * best), (6, t * count)):
                    x = np.concatenate([[0], np.cumsum(x)])
                    per[:, k] = x[ends[1:]] - x[ends[:-1]]
                total = np.concatenate([np.zeros((1, 7), np.int64), np.cumsum(per[inv], axis=0)])
                made.append(np.diff(total[at], axis=0) * fine[:, None])
                # links whose pair isn't among the common ones
                rare, rare_at = p[~hit], np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=len(known)))])
                rare_t = t[~hit]
                has = np.diff(rare_at)[inv] > 0
                texts = aligner.text
                for i in range(len(at) - 1):
                    if not fine[i]:
                        digest.append("")
                        rest.append(None)
                        continue
                    own = n[at[i]:at[i + 1]]
                    digest.append(hashlib.sha256(";".join([texts[k] for k in own.tolist()]).encode()).hexdigest())
                    if has[at[i]:at[i + 1]].any():
                        s = inv[at[i]:at[i + 1]][has[at[i]:at[i + 1]]]
                        q, e = gather(rare, rare_at, s)
                        w, _ = gather(rare_t, rare_at, s)
                        q, back = np.unique(q, return_inverse=True)
                        rest.append([{"pair": x, "times": y} for x, y in zip(q.tolist(), np.bincount(back, weights=w).astype(np.int64).tolist())])
                    else:
                        rest.append(None)
            m = np.concatenate(made) if made else np.zeros((0, 7), np.int64)
            new = {"n_a": 0, "n_b": 1, "n_groups": 2, "n_links": 3, "n_group_links": 4, "n_best": 5, "count_sum": 6}
            cols = [*batch.drop_columns([text]).columns, *[pa.array(m[:, k]) for k in new.values()], pa.array(digest, pa.string()),
                    pa.array(rest, schema.field("_rare").type)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
    return run


def align(docs: DataFrame, a: str, b: str, text: str = "text", common: int = COMMON) -> DataFrame:
    """Add the counts of tokens, groups and links of every text to its row (without the text).

    ``a``: path, on every machine, of a byte-level vocabulary for the tokenizers
    library, applied to a blank and the text; ``b``: path of a sentencepiece
    model that puts a blank before a text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StringType, StructType

    pairs = pair_counts(docs, a, b, text)
    table, all_common = _common(pairs, common)
    given = docs.sparkSession.sparkContext.broadcast(table) if table else None
    keep = [c for c in docs.columns if c != text and c not in MADE and c not in ("_rare", "_row")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text))
    out = StructType([f for f in rows.schema.fields if f.name != text])
    for c in ("n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_best", "count_sum"):
        out = out.add(c, LongType())
    rare = StructType().add("pair", LongType()).add("times", LongType())
    out = out.add("groups_sha256", StringType()).add("_rare", ArrayType(rare))
    scored = rows.mapInArrow(_score(a, b, text, given, to_arrow_schema(out)), out)
    if all_common:
        return scored.drop("_rare")
    scored = save(scored.withColumn("_row", F.monotonically_increasing_id()))
    rare = scored.filter("_rare IS NOT NULL").select("_row", F.explode("_rare").alias("r")).select("_row", "r.pair", "r.times")
    late = (rare.join(pairs, "pair").groupBy("_row")
            .agg(F.sum(F.col("times") * F.col("n")).alias("_count"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best")))
    return (scored.drop("_rare").join(late, "_row", "left")
            .withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_count", F.lit(0))})
            .drop("_row", "_best", "_count"))
