"""First-seen / top-k and the occurrence matrix against plain Python on
random inputs."""

import datetime as dt
import random

import pytest

from sparkcast.operators import articles as AR, pages as PG


@pytest.mark.parametrize("seed", [1, 2])
def test_first_seen_and_topk_random(spark, seed):
    rnd = random.Random(seed)
    hits = [(q, h, rnd.choice(["hot"] * 5 + [f"u{i}" for i in range(30)])) for q in range(20) for h in range(6)]
    visited = {f"u{i}" for i in range(0, 30, 7)}
    df = spark.createDataFrame(hits, "query_seq int, hit_seq int, url string")
    vis = spark.createDataFrame([(v,) for v in sorted(visited)], "url string")
    want, seen = {}, set(visited)
    for q, h, u in sorted(hits):            # walk queries and hits in order
        if u not in seen:
            seen.add(u)
            want[u] = (q, h)
    got = {r.url: (r.query_seq, r.hit_seq) for r in AR.first_seen(df, ["query_seq", "hit_seq"], visited=vis).collect()}
    assert got == want
    top = {(r.query_seq, r.hit_seq) for r in AR.top_k_hits(df, 3, ["query_seq"], ["hit_seq"]).collect()}
    assert top == {(q, h) for q, h, _ in hits if h < 3}


@pytest.mark.parametrize("seed", [5, 6])
def test_occurrence_matrix_random(spark, seed):
    rnd = random.Random(seed)
    fmts = ["%m-%Y", "%B-%Y", "%Y-%m"]
    countries, metrics = ["Kenya", "Chad", "Peru"], ["coup", "war", "flood"]
    rows = []
    for _ in range(25):
        dates = [dt.date(2020 + rnd.randint(0, 2), rnd.randint(1, 12), 1) for _ in range(rnd.randint(0, 3))]
        rows.append((rnd.choice(countries), rnd.choice(metrics), [d.strftime(rnd.choice(fmts)) for d in dates]))
    rows.append(("Chad", "war", ["05-2021"]))
    df = spark.createDataFrame(rows, "country string, metric string, dates array<string>")
    cells = PG.occurrence_cells(df, metrics)
    def parse(s):
        if s[2] == "-":
            return dt.datetime.strptime(s, "%m-%Y").date()
        if s[4] == "-" and s[:4].isdigit():
            return dt.datetime.strptime(s, "%Y-%m").date()
        return dt.datetime.strptime(s, "%B-%Y").date()

    all_d = [parse(s) for _, _, ds in rows for s in ds]
    lo, hi = min(all_d), max(all_d)
    n_months = (hi.year - lo.year) * 12 + hi.month - lo.month + 1
    present = {(m, c, parse(s).strftime("%m-%Y")) for c, m, ds in rows for s in ds}
    used = sorted({c for c, _, _ in rows})
    assert cells.count() == len(used) * len(metrics) * n_months
    ones = {(r.metric, r.country, r.month_label) for r in cells.where("present = 1").collect()}
    assert ones == present
