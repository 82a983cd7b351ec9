"""Packing against the library's ids, the rules of a packing and small optima."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from llm_cases import AWKWARD  # noqa: E402
from sparkcast.llm import packing as P, queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, _rank int, ids string"


def expand(where, counts, size):
    """[(sequence, offset, length)] of every piece under a plan."""
    out = []
    for x in np.flatnonzero(counts):
        rows = where[where[:, 0] == x]
        for r in range(counts[x]):
            _, first, each, base, off = rows[np.searchsorted(rows[:, 1], r, "right") - 1]
            out.append((base + (r - first) // each, off + (r - first) % each * x, x))
    return out


def whole(placed, size):
    seqs = defaultdict(list)
    for s, o, n in placed:
        seqs[s].append((int(o), int(n)))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= size
    return len(seqs)


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    random.seed(seed)
    size = random.choice([16, 64, 300])
    lens = [min(size, max(1, int(random.choice([random.expovariate(8 / size), random.randint(1, size), size // 2, 1])))) for _ in range(random.randint(1, 900))]
    counts = np.bincount(lens, minlength=size + 1)
    n = whole(expand(P.plan(counts, size), counts, size), size)
    least = -(-sum(lens) // size)
    least = max(least, sum(x > size // 2 for x in lens))
    assert least <= n <= least * 1.1 + 1


def test_exact_sums():
    """The index finds a combination of one to three pieces whenever there is one."""
    random.seed(5)
    for _ in range(60):
        counts = np.zeros(21, np.int64)
        for _ in range(random.randint(1, 7)):
            counts[random.randint(1, 20)] += random.randint(1, 2)
        s = P.Sums(counts, 20)
        for gap in range(1, 21):
            want = any(sum(c) == gap and all(counts[x] >= m for x, m in Counter(c).items())
                       for k in (1, 2, 3) for c in combinations_with_replacement(range(1, 21), k))
            found = s.exact(gap, {})
            assert (found is not None) == want and (not found or sum(found) == gap and all(counts[x] >= m for x, m in Counter(found).items()))


def expected(rows, size):
    t = tokenizers.Tokenizer.from_file(JSON)
    out = []
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out += [(i, k // size, k, len(ids[k:k + size]), zlib.crc32(ids[k:k + size].tobytes())) for k in range(0, len(ids), size)]
    return sorted(out, key=str)


def check(df, rows, size):
    got = df.collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == expected(rows, size)
    return whole([(r.sequence_id, r.offset, r.length) for r in got], size), sum(r.length for r in got)


def test_awkward(spark):
    rows = AWKWARD + [(1, "<|endoftext|>"), (2, "a<|endoftext|> b <|startoftext|>c"), (3, "x" * 3000 + " y"), (4, "É漢 " * 900), (5, "\n\n  A B's  "), (5, "\n\n  A B's  "),
                      (6, "á ́b c　d \x1c\x85e​f"), (7, "ΟΔΟΣ ΣΑΣ İ ǅ ﬁ"), (8, "don't 'll 1234 we've!?! " * 50)] + [(100 + i, "w " * (i % 9)) for i in range(200)]
    df = spark.createDataFrame([(*r, "x", 1, "i") for r in rows], SCHEMA).repartition(5)
    out = P.pack(P.token_pieces(df, JSON, size=64, keep_ids=True), size=64)
    n, tokens = check(out, rows, 64)
    assert n <= -(-tokens // 64) + 2
    seqs = {r.sequence_id: r for r in P.sequences(out).collect()}
    for r in out.collect():
        assert list(seqs[r.sequence_id].ids[r.offset:r.offset + r.length]) == list(r.ids)


def test_table_and_empty(spark):
    rows = [tuple(r) for r in spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect()]
    n, tokens = check(Q.op12_best_fit_packing(spark, SF), rows, 4096)
    assert n == -(-tokens // 4096)
    none = spark.createDataFrame([], SCHEMA)
    assert P.pack(P.token_pieces(none, JSON)).count() == 0
