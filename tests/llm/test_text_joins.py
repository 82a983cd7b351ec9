"""N-gram Jaccard join, repeated passages, decontamination against brute force."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from llm_cases import AWKWARD, frame
from sparkcast.llm import decontaminate as D, jaccard_join as J, queries as Q, repeats as R

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NO_ID = 1 << 62


def docs_of(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(sf + "/documents.parquet").collect()]


# --- Jaccard join ----------------------------------------------------------

def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(docs):
        least[find(k)].append(NO_ID if i is None else i)
    return sorted((str(i), len(s), str(None if min(least[find(k)]) == NO_ID else min(least[find(k)]))) for k, ((i, _), s) in enumerate(zip(docs, sets)))


def joined(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.near_duplicates(df).collect())


@pytest.fixture(scope="module")
def edited():
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    base = [[random.choice(words) for _ in range(random.choice([3, 5, 6, 30, 80, 200]))] for _ in range(20)]
    docs = []
    for i in range(200):
        b = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5])):
            p, r = random.randrange(len(b)), random.random()
            if r < .4:
                b[p] = random.choice(words)
            elif r < .7:
                b.insert(p, random.choice(words))
            elif len(b) > 1:
                del b[p]
        docs.append((i, " ".join(b)))
    return docs + AWKWARD + [(905, "a b c d e")]


def test_components(spark, edited):
    assert joined(frame(spark, edited)) == brute_components(edited)


def test_components_of_large_blocks(spark, edited, monkeypatch):
    monkeypatch.setattr(J, "TOKENS", 2000)
    monkeypatch.setattr(J, "MEMBERS", 20)
    monkeypatch.setattr(J, "PIVOTS", 2)
    assert joined(frame(spark, edited)) == brute_components(edited)


def test_components_table(spark):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in Q.op4_ngram_jaccard(spark, SF).collect())
    assert got == brute_components(docs_of(spark))


def test_one_of_each_group_stays(spark, edited):
    kept = J.drop_near_duplicates(frame(spark, edited)).select("doc_id", "text").collect()
    want = brute_components(edited)
    groups = collections.Counter(c for _, n, c in want if n and c != "None")
    got = collections.Counter(str(r.doc_id) for r in kept if shingles(r.text))
    assert all(got[c] == 1 for c in groups)
    assert sum(1 for r in kept if not shingles(r.text)) == sum(1 for _, n, _ in want if not n)
    assert sum(got.values()) == len(groups) + sum(1 for i, n, c in want if n and c == "None")


def test_join_empty(spark):
    assert J.near_duplicates(frame(spark, AWKWARD).limit(0)).count() == 0
    assert J.drop_near_duplicates(frame(spark, AWKWARD[:3])).count() == 3


# --- repeated passages -----------------------------------------------------

def brute_repeats(docs, size, keep):
    raw = [(t or "").encode() for _, t in docs]
    order = sorted(range(len(docs)), key=lambda k: -NO_ID if docs[k][0] is None else docs[k][0])
    seen = collections.defaultdict(list)
    for o, k in enumerate(order):
        for p in range(len(raw[k]) - size + 1):
            seen[raw[k][p:p + size]].append((o, p, k))
    gone = [bytearray(len(b)) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for x in places:
                first = min(places)
                if keep == "none" or x != first:
                    # what overlaps the first occurrence itself stays
                    begin = max(x[1], first[1] + size) if keep == "first" and x[2] == first[2] else x[1]
                    gone[x[2]][begin:x[1] + size] = b"\1" * (x[1] + size - begin)
    return sorted((str(i), len(b), sum(g), sum(1 for j in range(len(g)) if g[j] and not (j and g[j - 1])),
                   hashlib.sha256(bytes(c for c, x in zip(b, g) if not x)).hexdigest()) for (i, _), b, g in zip(docs, raw, gone))


def removed(df, size, keep):
    out = R.remove_repeats(df, size=size, keep=keep)
    return sorted((str(r[0]), *r[1:]) for r in out.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), "n_removed", "n_spans", F.sha2("kept", 256)).collect())


@pytest.fixture(scope="module")
def mixed():
    random.seed(3)
    base = ["".join(random.choice("abcdé ") for _ in range(random.randint(20, 120))) for _ in range(12)]
    docs = [(i, "".join(random.choice(base)[random.randint(0, 30):random.randint(20, 120)] for _ in range(random.randint(0, 6)))) for i in range(60)]
    return docs + [(200, "a" * 300), (203, "ab" * 90), (204, "x" * 19), (205, "x" * 20)] + [d for d in AWKWARD if len(d[1] or "") < 1000]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("contexts", [2000, 2])
def test_repeats(spark, mixed, keep, contexts, monkeypatch):
    monkeypatch.setattr(R, "CONTEXTS", contexts)
    assert removed(frame(spark, mixed), 20, keep) == brute_repeats(mixed, 20, keep)


def test_repeats_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 500)
    random.seed(8)
    one = "".join(random.choice("abcdefgh ") for _ in range(3000))
    docs = [(1, one), (2, one[700:1900]), (3, "zz" + one[100:160] + "yy" + one[2500:])]
    found = R._find_runs
    assert removed(frame(spark, docs), 50, "none") == brute_repeats(docs, 50, "none") and found


def test_repeats_table(spark):
    got = sorted((str(r[0]), *r[1:]) for r in Q.op10_suffix_dedup(spark, SF).collect())
    assert got == brute_repeats(docs_of(spark), 400, "none")


def test_repeated_rows_and_empty(spark):
    twice = [(1, "q" * 30 + "abcdefghijklmnopqrstuvwxyz"), (1, "q" * 30 + "abcdefghijklmnopqrstuvwxyz")]
    assert {r.n_removed for r in R.remove_repeats(frame(spark, twice), size=25, keep="none").collect()} == {56}
    rows = R.remove_repeats(frame(spark, twice), size=25, keep="first").collect()
    assert len({(r.n_removed, bytes(r.kept)) for r in rows}) == 1 and len(rows) == 2
    assert R.remove_repeats(frame(spark, twice).limit(0)).count() == 0


def test_strip_keeps_characters_and_columns(spark):
    docs = [(1, "xé" * 60), (2, "start " + "éyé" * 40 + " end"), (3, "other " + "éyé" * 40 + "!"), (4, "éyé" * 40), (5, None)]
    df = frame(spark, docs)
    out = R.strip_repeats(df, size=60)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[5] is None and 4 not in got
    # the first passage repeats itself: its first 60 bytes stay, whole characters
    assert got[2] == "start " + "éyé" * 12 + " end" and got[1] == "xé" * 20
    assert got[3] == "other!"           # the blank before the passage is part of a repeat, too


def test_strip_overlapping_repeats(spark):
    rows = [(1, "-" * 300), (2, "intro " + "abcde" * 40), (3, "x" * 99 + "-" * 150)]
    got = {r.doc_id: r.text for r in R.strip_repeats(frame(spark, rows), size=100).collect()}
    assert got == {1: "-" * 100, 2: "intro " + "abcde" * 20, 3: "x" * 99}


def doubled(n):
    """Two unequal strings that a polynomial hash modulo a power of two can't tell apart."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024])
def test_doubled_strings(spark, n):
    a, b = doubled(n)
    rows = [(1, " ".join(["one two three four", a])), (2, " ".join(["one two three four", b])), (3, " ".join(["one two three four", a]))]
    got = {r.doc_id: r.component_id for r in J.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    rows = [(1, a + "!"), (2, b + "?"), (3, "+" + a)]
    assert removed(frame(spark, rows), n, "none") == brute_repeats(rows, n, "none")


# --- decontamination -------------------------------------------------------

def test_leaks_table(spark):
    got = {(r.doc_id, r.item_id) for r in Q.op6_decontamination(spark, SF).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    assert got == {(i, j) for i, t in docs_of(spark) for j, x in items if x in (t or "")} and got


def brute_bm25(items, passage):
    """Score shares by the textbook formula, over all items."""
    import math
    words = [re.findall(r"[a-z0-9\u0080-\U0010ffff]+", x.lower()) for x in items]
    df = collections.Counter(w for ws in words for w in set(ws))
    mean = sum(map(len, words)) / len(words)
    own = set(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", passage.lower()))
    out = []
    for ws in words:
        tf = collections.Counter(ws)
        x = {w: math.log(1 + (len(items) - df[w] + .5) / (df[w] + .5)) * n * (D.K1 + 1) / (n + D.K1 * (1 - D.B + D.B * len(ws) / mean)) for w, n in tf.items()}
        out.append(sum(v for w, v in x.items() if w in own) / sum(x.values()))
    return out


def test_wand_returns_all_above_threshold(spark):
    import numpy as np
    import pyarrow as pa
    from sparkcast.llm import textbytes as tb
    random.seed(4)
    words = [f"t{i}" for i in range(120)]
    items = [" ".join(random.choice(words[:random.choice([20, 60, 120])]) for _ in range(random.randint(6, 30))) for _ in range(70)]
    df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    index, = list(D._indexes(df, "item_id", "text"))
    found = near = 0
    for _ in range(60):
        base = random.choice(items).split()
        passage = " ".join([w if random.random() < .75 else random.choice(words) for w in base] + [random.choice(words) for _ in range(15)])
        buf, offs = tb.column(pa.array([passage]))
        w, t = tb.word_hashes(buf, offs, tb.PUNCTUATION)
        got = {i: s for _, _, i, s in D.retrieve(index, w, t, 256)}
        want = {i: s for i, s in enumerate(brute_bm25(items, passage)) if s >= D.THRESHOLD}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
        found += len(want)
    assert found > 20 and near == 0 and isinstance(index.ids, np.ndarray)


def test_leaks_awkward(spark, monkeypatch):
    items = spark.createDataFrame([(1, "What is the tallest known tree today? The answer is one old redwood in the north"), (2, None), (3, ""), (4, "solo"),
                                   (1, "second text under the very same item id with words"), (5, "!!!")], "item_id long, text string")
    docs = AWKWARD + [(1, "Before. " * 200 + "what is the TALLEST known tree today -- the answer is one old redwood in the north. " + "After. " * 300),
                      (2, "What is the tallest known tree today? Nobody here knows."), (3, "a SOLO voice"), (1, "second text under the very same item id with words"),
                      (4, "words with id item same very the under text second")]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(frame(spark, docs), items).collect()}
    assert got == {(1, 1), (3, 4)}
    monkeypatch.setattr(D, "SHARD", 10)
    assert got == {(r.doc_id, r.item_id) for r in D.find_leaks(frame(spark, docs), items).collect()}
    kept = D.drop_leaks(frame(spark, docs), items)
    assert kept.columns == frame(spark, docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in docs if (i, t) not in (docs[-5], docs[-3], docs[-2]))
    assert D.find_leaks(frame(spark, docs), items.limit(0)).count() == 0 and D.drop_leaks(frame(spark, docs).limit(0), items).count() == 0


def test_thresholds_under_a_half_are_refused(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    for f in (J.near_duplicates, J.drop_near_duplicates):
        with pytest.raises(ValueError):
            f(df, num=49, den=100)
