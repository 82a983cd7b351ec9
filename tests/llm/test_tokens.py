"""Token counts and byte-level BPE against the public libraries."""

import base64
import hashlib
import random
import time

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")
regex = pytest.importorskip("regex")

import numpy as np  # noqa: E402
from llm_cases import AWKWARD, frame  # noqa: E402
from sparkcast.llm import byte_bpe, pretoken, queries as Q, textbytes as tb  # noqa: E402
from sparkcast.llm.byte_bpe import Encoder, encode_decode  # noqa: E402
from sparkcast.llm.token_counts import count_tokens  # noqa: E402

SF = "/root/testdata/sf0.001"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = AWKWARD + [(1, "<|endoftext|>"), (2, "a<|endoftext|>b <|endoftext|>"), (3, "x" * 5000 + " y"), (4, "é漢 " * 3000),
                   (5, "\n\n  a b  "), (6, "a <|endoftext|> b" * 3000), (7, "   a" * 5000), (8, "'s 'll don't we'VE" * 500), (5, "\n\n  a b  ")]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tokenizers.Tokenizer.from_file(JSON), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pretoken_matches_pattern():
    random.seed(1)
    parts = ["a", "s", "t", "'", "'s", "'re", "'ll", "'ve", " ", "  ", "\n", "\t", "é", "1", "2²", "!", " ", "　", "漢", "\U0001F600", "\x1c", "\x85", "don't"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(8000)]
    pat = regex.compile(public_tokenizers.PATTERN)
    for first, buf, offs in tb.slices(pa.array(texts), 10_000):
        st, raw = pretoken.starts(buf, offs), buf.tobytes()
        k, end = np.searchsorted(st, offs), np.append(st[1:], len(buf))
        for i in range(len(offs) - 1):
            assert [raw[a:b].decode() for a, b in zip(st[k[i]:k[i + 1]], end[k[i]:k[i + 1]])] == pat.findall(texts[first + i])


@pytest.mark.parametrize("chunk", [1 << 16, 1000, 17])
def test_counts_awkward(spark, library, chunk):
    out = count_tokens(frame(spark, TEXTS), JSON, limit=10, chunk=chunk)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "_maybe_not", "n_bytes", "n_tokens", "over_limit"}
    got = sorted(((r.text or "", r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()))
    want = [(t or "", len((t or "").encode()), len(library[0].encode(t or "", add_special_tokens=False).ids)) for _, t in TEXTS]
    assert got == sorted((*w, w[2] > 10) for w in want)


def test_counts_table(spark, library):
    got = {r.doc_id: r.n_tokens for r in Q.op8_token_counts(spark, SF).collect()}
    docs = spark.read.parquet(SF + "/documents.parquet").collect()
    enc = library[0].encode_batch([r.text or "" for r in docs], add_special_tokens=False)
    assert got == {r.doc_id: len(e.ids) for r, e in zip(docs, enc)}


def test_bpe_awkward(spark, library):
    rows = encode_decode(frame(spark, TEXTS), RANKS).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.ids == library[1].encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_bpe_table(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in Q.op9_byte_bpe(spark, SF).collect()}
    for r in spark.read.parquet(SF + "/documents.parquet").collect():
        ids = library[1].encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_empty_tables(spark):
    none = frame(spark, AWKWARD).limit(0)
    assert count_tokens(none, JSON).count() == 0 and encode_decode(none, RANKS).count() == 0


def test_doubled_strings(spark, library):
    """Unequal words that a polynomial hash modulo a power of two can't tell apart."""
    s = "a"
    while len(s) < 512:
        s += s.translate(str.maketrans("ab", "ba"))
    words = [s, s.translate(str.maketrans("ab", "ba")), s * 2, s + s.translate(str.maketrans("ab", "ba"))]
    rows = [(i, " ".join([words[i], words[(i + 1) % 4], words[i]])) for i in range(4)]
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, rows), JSON).collect()}
    assert got == {i: len(library[0].encode(t, add_special_tokens=False).ids) for i, t in rows}
    rows = [(i, t[:1026]) for i, t in rows]
    for r in encode_decode(frame(spark, rows), RANKS).collect():
        assert r.ids == library[1].encode_ordinary(r.text) and bytes(r.decoded) == r.text.encode()


def test_long_words(library):
    """Seams of blocks: runs, overlapping pairs, random letters; a megabyte in one word in bounded time."""
    random.seed(3)
    e = Encoder.of(RANKS)
    words = ["x" * n for n in (64, 65, 66, 97, 1000)] + ["ab" * 500 + "a", "-" * 333 + "=" * 99, "漢字é" * 300]
    words += ["".join(random.choices(a, k=random.randint(60, 400))) for a in ("ab", "aab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "the") for _ in range(60)]
    ids, back = e.merged([w.encode() for w in words])
    for w, i, b in zip(words, ids, back):
        assert i == library[1]._core_bpe.encode_single_piece(w.encode()) and b == w.encode()
    whole = "".join(random.choices("etaoinshrdlu", k=1 << 20)).encode()
    began = time.monotonic()
    (i,), (b,) = e.merged([whole])
    assert time.monotonic() - began < 60
    assert i == library[1]._core_bpe.encode_single_piece(whole) and b == whole


def test_known_words_are_bounded(monkeypatch, library):
    """Beyond the pool an encoder starts anew; ids stay the same."""
    monkeypatch.setattr(byte_bpe, "POOL", 2000)
    e = Encoder(RANKS)
    texts = [" ".join("".join(random.choices("abcdefgh", k=40)) for _ in range(60)) for _ in range(8)] * 2
    for t in texts:
        assert e.encode(pa.array([t]), decode=False)[0].as_py() == library[1].encode_ordinary(t)
        assert len(e.raw) <= 2000 + len(t)


def test_chunk_maps_carry_states(spark, library):
    """Long words, runs, special strings and white space cut anywhere; composed in several levels."""
    random.seed(5)
    special = "<|endoftext|>"
    parts = ["a", "ab", "x" * 40, "é漢", " ", "  ", "\n\n", "'s", "'", "re", "12", "!?", "\U0001F600", special, special[:5], "the", "don't", "\t"]
    texts = ["".join(random.choices(parts, k=400)) for _ in range(12)]
    texts += ["".join(random.choices("etaoinshrdlu", k=9000)), "=" * 7000, "ab" * 4000 + "a", special * 300, "漢字" * 2000, " " * 3000 + "x", "\n" * 2999]
    want = [len(e.ids) for e in library[0].encode_batch(texts, add_special_tokens=False)]
    for chunk in (100, 1024):
        got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, list(enumerate(texts))), JSON, chunk=chunk).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_wrong_guess_is_mended(library):
    """A map entered with a state it wasn't guessed for gives the library's count."""
    from sparkcast.llm.token_counts import BETWEEN, Counter
    c = Counter.of(JSON)
    t = b"=" * 5003
    _, state, n = c.chunk(t[:2001 + 256], 0, 2001, True, False, None)[0]
    assert state != BETWEEN
    seen = t[2001 - 256:]
    guess = c.chunk(seen, 256, len(seen), False, True, None)[0][0]
    end, more = {s: (t, m) for s, t, m in c.chunk(seen, 256, len(seen), False, True, [state])}[state]
    assert guess != state and end == BETWEEN and n + more == len(library[0].encode(t.decode(), add_special_tokens=False).ids)


def test_long_word_is_counted_by_several_tasks(spark, library):
    """Ten megabytes without white space: every chunk is a task's row of its own."""
    random.seed(6)
    text = "".join(random.choices(["the", "ing", "q", "x7", "Zeta", "-", "漢"], k=1_200_000))[:3_300_000]
    text *= -(-10_000_000 // len(text.encode()))
    row = count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), JSON).first()
    assert row.n_bytes == len(text.encode()) >= 10_000_000
    assert row.n_tokens == len(library[0].encode(text, add_special_tokens=False).ids)


def test_byte_bpe_looks_at_small_slices(monkeypatch):
    """Arrays of characters are made for a slice at a time; new words are merged for several slices together; what other operators kept goes."""
    import public_tokenizers
    import pyarrow as pa

    from sparkcast.llm import byte_bpe as B, pretoken, textbytes as tb
    col = pa.array([f"some words, ne{i}w{i * 7} été " * 40 for i in range(1500)])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    other = {"index": 1}
    monkeypatch.setattr(tb, "kept", [*tb.kept, other])
    B._encoders.clear()
    e = B.Encoder.of(path)
    assert not other
    sizes, queries = [], []
    starts, merged = pretoken.starts, e.merged
    monkeypatch.setattr(pretoken, "starts", lambda buf, offs: (sizes.append(len(buf)), starts(buf, offs))[1])
    monkeypatch.setattr(e, "merged", lambda words: (queries.append(len(words)), merged(words))[1])
    got = e.encode(col)
    assert sum(sizes) > 1_500_000 and max(sizes) <= 300_000
    assert len(queries) < len(sizes)
    assert got.field("decoded").to_pylist() == [x.encode() for x in col.to_pylist()]
    e._reset()
    one = [e.encode(col.slice(i, 1), decode=False).to_pylist()[0] for i in (0, 777, 1499)]
    assert one == [got.field("ids")[i].as_py() for i in (0, 777, 1499)]


def test_byte_bpe_keeps_little_between_batches(monkeypatch, library):
    """No database between batches; of known words those met again stay, with the library's ids."""
    random.seed(8)
    e = Encoder(RANKS)
    monkeypatch.setattr(e.cache, "limit", 300)
    common = " ".join(f"often{i}x" for i in range(40))
    for _ in range(12):
        t = common + " " + " ".join("".join(random.choices("abcdefgh", k=12)) for _ in range(60))
        got = e.encode(pa.array([t, None, ""]).fill_null(""))
        assert got.field("ids").to_pylist() == [library[1].encode_ordinary(t), [], []]
        assert got.field("decoded").to_pylist() == [t.encode(), b"", b""]
        assert e.db is None and len(e.cache) == len(e.again) == len(e.id_at) - 1 == len(e.raw_at) - 1 <= 500
    merged, asked = e.merged, []
    e._forget()
    monkeypatch.setattr(e, "merged", lambda words: (asked.extend(words), merged(words))[1])
    e.encode(pa.array([common]))
    assert asked == []


def test_character_classes_take_little_memory(monkeypatch):
    """The class table isn't made from a Python object a character."""
    import tracemalloc
    old = pretoken._classes()
    monkeypatch.setattr(pretoken, "_table", None)
    tracemalloc.start()
    new = pretoken._classes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and (new == old).all()
