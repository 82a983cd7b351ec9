"""Alignment of two tokenizers against plain loops over the libraries' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from llm_cases import AWKWARD  # noqa: E402
from sparkcast.llm import alignment as A, queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, _row int, pair string"
TEXTS = AWKWARD + [(1, "<|endoftext|> <s>x</s><unk>"), (2, " a  b \n c\t  d "), (3, "x▁y and"), (4, "don't 'tis we'll,ok"), (5, " "), (6, "a　 b  c\xa0 d\x85 e"), (7, "ﬁ Å İ x\x00y \x1c z"),
                   (8, "abc123 45,6.7 (foo) [bar]\r\n\r\n  end."), (8, "abc123 45,6.7 (foo) [bar]\r\n\r\n  end."), (9, "漢字かな交じり文 \U0001F600\U0001F468‍\U0001F469"), (10, "   "), (11, "\n"), (12, "a ")]


def tokens():
    t, s = tokenizers.Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t.encode_special_tokens = True
    vocab = {i: w for w, i in t.get_vocab().items()}
    table = {}
    n = 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            table[chr(b)] = b
        else:
            table[chr(256 + n)] = b
            n += 1
    return (lambda x: [(i, bytes(table[c] for c in vocab[i])) for i in t.encode(" " + x, add_special_tokens=False).ids],
            lambda x: [(i, bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()) for i in s.encode(x) for p in [s.id_to_piece(i)]])


def plain(rows):
    in_a, in_b = tokens()
    docs = []
    for i, text in rows:
        a, b = (in_a(text), in_b(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(x[1] for x in a) != whole or b"".join(x[1] for x in b) != whole:
            a, b = [], []
        ae, be = np.cumsum([0, *[len(x[1]) for x in a]]).tolist(), np.cumsum([0, *[len(x[1]) for x in b]]).tolist()
        links, j = [], 0
        for k in range(len(a)):
            while be[j + 1] <= ae[k]:
                j += 1
            m = j
            while m < len(b) and be[m] < ae[k + 1]:
                links.append((a[k][0], b[m][0]))
                m += 1
        cuts = sorted(set(ae[1:]) & set(be[1:]))
        groups = [([a[k][0] for k in range(len(a)) if lo < ae[k + 1] <= hi], [b[k][0] for k in range(len(b)) if lo < be[k + 1] <= hi]) for lo, hi in zip([0, *cuts], cuts)] if len(a) < 3000 else None
        docs.append((i, a, b, links, cuts, groups))
    count = Counter(x for d in docs for x in d[3])
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for i, a, b, links, cuts, groups in docs:
        text = None if groups is None else "" if not a else hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        out.append((i, len(a), len(b), len(cuts), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), text, sum(len(x) * len(y) for x, y in groups) if groups else 0))
    return out


def compare(df, rows):
    got = sorted([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_group_links) for r in df.collect()], key=str)
    want = sorted(plain(rows), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7:] == w[7:])


@pytest.mark.parametrize("common", [1 << 19, 40, 0])
def test_awkward(spark, common):
    random.seed(1)
    parts = ["a", "Wort", "'s", "'", " ", "  ", "\n", "\t", "é", "1", "42", "!", ",", ".", "\xa0", "漢", "don't", "(", "_", "Straße", "\U0001F600", "​", "́"]
    rows = TEXTS + [(100 + i, "".join(random.choice(parts) for _ in range(random.randint(1, 25)))) for i in range(120)]
    df = spark.createDataFrame([(*r, "x", 1, "p") for r in rows], SCHEMA).repartition(3)
    compare(A.align(df, JSON, MODEL, common=common), rows)


def test_table_and_empty(spark):
    rows = [tuple(r) for r in spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect()]
    compare(Q.op11_token_alignment(spark, SF), rows)
    assert A.align(spark.createDataFrame([], SCHEMA), JSON, MODEL).count() == 0


def test_products():
    random.seed(2)
    for _ in range(200):
        n = random.randint(1, 40)
        ends = [np.array(sorted({n, *random.sample(range(1, n + 1), random.randint(1, n))})) for _ in range(2)]
        dense = [np.array([[lo <= k < hi for k in range(n)] for lo, hi in zip([0, *e], e)], int) for e in ends]
        links = A.overlap_links(*ends, n)
        full = np.zeros((len(ends[0]), len(ends[1])), int)
        full[links.rows(), links.col] = links.val
        assert (full == dense[0] @ dense[1].T).all()
        cut = sorted(set(ends[0]) & set(ends[1]))
        g = [np.searchsorted(cut, e) for e in ends]
        links = A.group_links(*ends)
        full[:] = 0
        full[links.rows(), links.col] = links.val
        assert (full == (g[0][:, None] == g[1][None, :])).all()


def test_small_memory():
    """The same answers when what is known is forgotten again and again."""
    col = pa.array([t or "" for _, t in TEXTS])
    one, two = A.Aligner(JSON, MODEL), A.Aligner(JSON, MODEL, limit=0)
    for x, y in zip(one.texts(col), two.texts(col)):
        assert (x[3] == y[3]).all() and (one.stat[x[1]] == two.stat[y[1]]).all()
