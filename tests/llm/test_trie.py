"""Prefix trie and tree contraction against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from sparkcast.llm import queries as Q
from sparkcast.llm.contraction import subtree_totals
from sparkcast.llm.prefix_trie import prefix_trie, shared_heads, turns

SCHEMA = "conv_id long, turn long, role string, text string, pos int, unit string, bytes string, id long"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            t = text or ""
            own[c].append(((turn is not None, turn or 0), role or "", hashlib.sha256(t.encode()).digest(), t))
    seq = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in seq}
    return {c: seq.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h[c]] + seq[c][h[c]:] for c in seq}


def plain(convs):
    """Rows of the trie from {conversation: turns}."""
    members = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = own + sum(saved[x] for x in kids[k])
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k)))).encode()).hexdigest()) for k, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *tuple(r)[3:]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "u", "b", 2) for r in rows], SCHEMA)


def cases():
    random.seed(3)
    rows = [(c, t, random.choice(["user", "assistant", None]), random.choice(["a", "b", "é", "", None])) for c in range(60) for t in range(random.randint(1, 9))]
    rows += [(100, t, "user", f"turn {t % 3}") for t in range(70)] + [(101, t, "user", f"turn {t % 3}") for t in range(64)] + [(102, t, "user", "turn 0") for t in range(9)]
    rows += [(7, 1, "user", "a")] * 3 + [(8, None, None, None), (8, None, "z", "zz"), (None, 1, "user", "x"), (-3, 0, "user", "m"), (-6, 0, "user", "m"), (0, 0, "user", "x" * 100_000)]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_trie(spark, block):
    rows = cases()
    df = prefix_trie(*shared_heads(turns(frame(spark, rows).repartition(5))), block=block, span=7)
    assert got(df) == plain(rebuilt(rows))


def test_trie_table_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(sf + "/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(Q.op13_prefix_trie(spark, sf)) == plain(rebuilt(rows))
    assert prefix_trie(*shared_heads(turns(frame(spark, cases()).limit(0)))).count() == 0


def test_long_and_copied(spark):
    """One conversation of a third of all rows, a first turn of all others."""
    rows = [(5, t, "u", str(t % 7)) for t in range(300)] + [(c, t, "u", "same" if t < 3 else str(c)) for c in range(10, 300, 5) for t in range(5)]
    assert got(prefix_trie(*shared_heads(turns(frame(spark, rows))), block=16, span=16)) == plain(rebuilt(rows))


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_subtree_totals(spark, kind):
    n = 120
    random.seed(kind)
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: random.randrange(i)}[kind]
    parent = {i: (up(i) if i else None) for i in range(n)}
    w = {i: random.randint(-5, 9) for i in range(n)}
    want = dict(w)
    for i in range(n - 1, 0, -1):
        want[parent[i]] += want[i]
    df = spark.createDataFrame([(f"n{i}", None if p is None else f"n{p}", w[i], 1) for i, p in parent.items()], "node string, parent string, w int, one int")
    out = {r.node: (r.w, r.one) for r in subtree_totals(df, ["w", "one"]).collect()}
    assert {k: v[0] for k, v in out.items()} == {f"n{i}": x for i, x in want.items()} and out["n0"][1] == n


def test_broken_forests(spark):
    with pytest.raises(ValueError):
        subtree_totals(spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "node string, parent string, w int"), ["w"])
    assert subtree_totals(spark.createDataFrame([], "node string, parent string, w int"), ["w"]).count() == 0
