"""WARC archives, URL rules, neighbour search."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from sparkcast.llm import neighbours as N, queries as Q, url_rules as U, warc as W

SF = "/root/testdata/sf0.001"


def duck(sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    return sorted(map(str, con.execute(sql).fetchall()))


@pytest.mark.parametrize("name", ["op1_warc", "op2_url_rules"])
def test_against_sql(spark, name):
    assert sorted(str(tuple(r)) for r in Q.QUERIES[name](spark, SF).collect()) == duck(Q.SQL[name])


PAGES = [(1, "u1", "x" * 5000), (2, "u2", "x" * 5000), (2, "u2", "x" * 5000), (2, "other", "x" * 5000), (3, None, None), (4, "u\r\n4", "é" * 700),
         (5, "u5", ""), (6, "u6", "é" * 700), (7, "u", "short"), (8, "u", "short"), (None, "n", "y" * 3000), (9, "z", "y" * 3000),
         (10, "long", "ab\r\n\r\n" * 20_000), (11, "a", "q" * 2000), (11, "a", "q" * 2000)]


def test_archives(spark):
    df = spark.createDataFrame([(*p, "extra", 3) for p in PAGES], "page_id long, url string, html string, size string, no int")
    folder = W.new_folder(spark)
    written = W.write_archives(df, folder, chunk=1000, roll=2000)
    assert written.count() > 0 and all(r.bytes > 0 for r in written.collect())
    rows = W.read_archives(written, folder, keep_chunks=False).collect()
    assert len(rows) == len(PAGES)
    kinds = collections.Counter((r.id, r.record_type, r.refers_to) for r in rows)
    assert kinds == collections.Counter([
        (1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (2, "revisit", 2), (3, "response", None), (4, "revisit", 6), (5, "response", None),
        (6, "response", None), (7, "response", None), (8, "response", None), (None, "revisit", 9), (9, "response", None), (10, "response", None),
        (11, "response", None), (11, "revisit", 11)])
    html = {(i, u): (h or "").encode() for i, u, h in PAGES}
    for r in rows:
        assert r.size == len(html[r.id, r.url]) and r.digest == hashlib.sha1(html[r.id, r.url]).hexdigest()
    back = collections.defaultdict(bytes)
    for r in sorted(W.read_archives(written, folder, chunk=700).collect(), key=lambda r: r.no):
        assert len(r.chunk) <= 700
        back[r.id, r.record_type] += bytes(r.chunk)
    assert back[10, "response"] == PAGES[12][2].encode() and back[4, "revisit"] == b"" and back[6, "response"] == ("é" * 700).encode()


def test_chunks_carry_running_digests(spark):
    df = spark.createDataFrame([(1, "u", "abcdefgh" * 10), (2, "u", None)], "page_id long, url string, html string")
    rows = sorted(W.chunk_table(df, "page_id", "url", "html", chunk=30).collect(), key=lambda r: (r.id, r.no))
    data = b"abcdefgh" * 10
    assert [(r.no, r.digest) for r in rows if r.id == 1] == [(i, hashlib.sha1(data[:30 * (i + 1)]).hexdigest()) for i in range(3)]
    assert [(r.size, r.digest) for r in rows if r.id == 2] == [(0, hashlib.sha1().hexdigest())]


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = W.new_folder(spark)
    written = W.write_archives(df, folder)
    assert written.count() == 0 and W.read_archives(written, folder).count() == 0


# --- URL rules -------------------------------------------------------------

RULES = [("net", "", "block"), ("a.net", "/en", "allow"), ("a.net", "/en/", "block"), ("NET", "/e", "allow"), ("org", "/fr/f", "block"), ("org", "/", "allow"),
         (None, "/", "block"), ("b.a.net", None, "block"), ("x.org", "/fr/fr/", "allow"), ("net", "/en", "block"), ("net", "//", "allow"), ("net", "//", "allow")]


def brute_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(U.UPPER, U.LOWER)), m[2]) if m else ("", "")
    fits = []
    for h, p, v in RULES:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h) + len(p), len(h), v == "block", h + p, v))
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "deny")


def test_url_rules(spark):
    random.seed(2)
    hosts = ["a.net", "net", "b.a.net", "x.org", "", "A.NET", "a..net", "org.", "net.a", "Ä.net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/fr/fr/", "//", "/enx", "/a/b/c/d", "/" * 3000]
    urls = [None, "", "nohost", "://", "http://", "x://net", "http://a.net?x=/en/", "http://a.net#/", "ftp://a.net/en\n/x", "http://a\n.net/q", "q?u=http://a.net/en/"]
    urls += ["http://" + random.choice(hosts) + random.choice(paths) + random.choice(["", "?q", "#f", "?a#b"]) for _ in range(120)]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(0, None, "clash", "clash")], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = U.judge(df, rules, default="deny").collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id])
    assert {r.verdict for r in U.judge(df, rules.limit(0)).collect()} == {"allow"} and U.judge(df.limit(0), rules).count() == 0


# --- neighbours ------------------------------------------------------------

def brute_neighbours(rows, k):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in rows], float)
    out = {}
    for (i, v) in rows:
        if i % 100 == 0:
            d = ((x - np.array(v, float)) ** 2).sum(1) ** .5
            out[i] = sorted((round(float(s), 9), j) for s, (j, _) in zip(d, rows) if j != i)[:k]
    return out


def test_neighbours_awkward(spark, monkeypatch):
    monkeypatch.setattr(N, "EXPAND", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in np.round(v, 3)]) for i, v in enumerate(rng.standard_normal((150, 6)))]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [rows[7], rows[100]]
    odd = [(300, None), (400, [0.0] * 6), (500, [1.0, None, 0.0, 0.0, 0.0, 1.0]), (600, [float("nan")] + [1.0] * 5), (700, [float("inf")] + [1.0] * 5),
           (800, [1.0, 2.0]), (None, [1.0] * 6), (900, [])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int, score double")
    got = collections.defaultdict(list)
    for r in N.search(df, df.filter("vec_id % 100 = 0"), k=10, degree=8, beam=120).collect():
        got[r.query_id].append((r["rank"], round(r.score, 9), r.vec_id))
    want = brute_neighbours(rows, 10)
    assert set(got) == set(want)
    for q, rows_of in got.items():
        assert [r for r, _, _ in sorted(rows_of)] == list(range(1, 11))
        assert [(s, j) for _, s, j in sorted(rows_of)] == want[q]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    rows = N.search(df, df.filter("vec_id = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 1)] and abs(rows[0].score - 2 ** .5) < 1e-12
    assert N.search(df.limit(0), df.limit(0)).count() == 0 and N.search(df.limit(1), df.limit(1)).count() == 0


def test_recall_on_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(SF + "/embeddings.parquet").collect()]
    want = brute_neighbours(rows, 10)
    got = collections.defaultdict(set)
    for r in Q.op3_nn_descent(spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {j for _, j in w}) for q, w in want.items()) / sum(map(len, want.values())) >= 0.95


def uniform(spark, n, dim=32):
    x = np.random.default_rng(5).standard_normal((n, dim))
    return x, spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")


def test_graph_settles(spark, monkeypatch):
    """Rounds go on until few edges change, however many that takes."""
    _, df = uniform(spark, 3000)
    nodes = N.save(N.vectors(df, "vec_id", "embedding").withColumn("c", N._code("v")).select("node", "c.*"))
    made, save = [], N.save

    def spy(x):
        out = save(x)
        if out.columns == ["a", "b", "d", "fresh"]:
            made.append(out)
        return out
    monkeypatch.setattr(N, "save", spy)
    monkeypatch.setattr(N, "BLOCK", 8)
    N.build_graph(nodes, 6)
    last, before = ({(r.a, r.b) for r in x.collect()} for x in (made[-1], made[-2]))
    assert len(made) < N.ROUNDS and len(last - before) <= N.SETTLED * len(last)


def test_settings_follow_the_row_count():
    few, many, more = (N.settings(n) for n in (N.SMALL, 51_300, 205_000))
    assert (few["beam"], few["expand"]) == (N.BEAM, N.EXPAND)
    assert all(few[k] < many[k] < more[k] for k in few) and more["beam"] >= 2 * N.BEAM


@pytest.mark.parametrize("noise", [1e-4, 1e-3])
def test_near_copies_in_true_order(spark, noise):
    """A group of 1,000 whose distances lie under the step of the codes."""
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = np.concatenate([unit(rng.standard_normal((1, 64))) + noise * rng.standard_normal((1000, 64)), unit(rng.standard_normal((200, 64)))])
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_neighbours(rows, 10)
    got = collections.defaultdict(set)
    for r in N.search(df, df.filter("vec_id % 100 = 0"), k=10).collect():
        got[r.query_id].add(r.vec_id)
    near = [q for q in want if q < 1000]
    assert sum(len(got[q] & {j for _, j in want[q]}) for q in near) >= 0.95 * 10 * len(near)


def test_archives_of_rows_without_ids(spark):
    """Payloads repeat under null ids; URLs come back as they were."""
    urls = [" u\nv ", "\r\n", "", "http://a/?q=%20x", None, " x"]
    df = spark.createDataFrame([(None, u, "y" * 2000) for u in urls[:2]] + [(i, u, "z" * 10) for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = W.new_folder(spark)
    rows = W.read_archives(W.write_archives(df, folder), folder, keep_chunks=False).collect()
    assert sorted((r.url or "", r.url is None) for r in rows if r.id is not None) == sorted((u or "", u is None) for u in urls)
    assert all(r.refers_to is None for r in rows) and sorted(r.record_type for r in rows if r.id is None) == ["response", "revisit"]
