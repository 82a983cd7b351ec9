"""Exact touches and per-region forests against small hand-made and brute-force cases."""

import datetime as dt
import random

import pytest
from sparkcast.operators import region_forests as RF
from sparkcast.operators.touches import touching


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


SHAPES = {
    "A": [box(0, 0, 2, 2)],
    "B": [box(2, 0, 4, 2)],                           # shares a border with A
    "C": [box(2, 2, 3, 3)],                           # corner of A, border of B
    "D": [box(1, 1, 5, 1.5)],                         # crosses A and B
    "E": [box(2, 0, 4, 2)],                           # equal to B
    "F": [box(0.5, -1, 1.5, 0)],                      # T-junctions on A's lower border
    "G": [box(10, 0, 20, 10), box(12, 2, 18, 8)],     # with a hole
    "H": [box(12, 2, 18, 8)],                         # fills the hole
    "I": [box(13, 0, 14, 1)],                         # inside G, on its border
    "J": [box(30, 0, 31, 1)],                         # alone
    "K": [box(20, 10, 21, 11), box(11, 1, 11.5, 1.5)],  # a corner of G, and an island inside G
    "L": [[(4, 0), (6, 0), (4, 2), (4, 0)]],          # triangle beside B
    "M": [[(6, 0), (6, 2), (4, 2), (6, 0)]],          # along L's long side
    "N": [[(4, 2), (6, 0), (7, 3), (4, 2)]],          # over that side, overlaps M
    "P": [box(12, 3, 13, 4)],                         # in the hole: touches G, lies in H
    "Q": [],
}
TOUCH = {"AB", "AE", "AC", "BC", "CE", "AF", "GH", "GP", "BL", "EL", "LM", "LN", "BM", "EM", "BN", "EN"}


def test_touching(spark):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in v]) for k, v in SHAPES.items()]
    df = spark.createDataFrame(rows, "region_id string, rings array<array<struct<x: double, y: double>>>")
    for cell in (0.7, 100.0):
        got = {(r.region_id, r.neighbour_id) for r in touching(df, cell=cell).collect()}
        assert got == {p for x in TOUCH for p in ((x[0], x[1]), (x[1], x[0]))}


def test_meetings_are_spread(spark):
    """Segments of one file and few bytes: the pairs aren't all one task's."""
    from sparkcast.operators import touches as T
    rows = [(k, [[{"x": float(x + 3 * k), "y": float(y)} for x, y in box(0, 0, 3, 3)]]) for k in range(40)]
    df = spark.createDataFrame(rows, "region_id long, rings array<array<struct<x: double, y: double>>>").coalesce(1)
    met = T._meetings(T.ring_segments(df), 4.0, 1e-9)
    assert len([n for n in met.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]) > 1
    assert touching(df, cell=4.0).count() == 2 * 39


def test_touching_empty(spark):
    df = spark.createDataFrame([], "region_id string, rings array<array<struct<x: double, y: double>>>")
    assert touching(df).count() == 0


def best(rows, k):
    """(feature, threshold) of the best split of [(x, y, w)], or None."""
    w, s, q = (sum(f(r) for r in rows) for f in (lambda r: r[2], lambda r: r[2] * r[1], lambda r: r[2] * r[1] ** 2))
    err, out = q - s * s / w if w else 0, None
    if err <= 1e-9:
        return None
    for f in range(k):
        vs = sorted({r[0][f] for r in rows})
        for lo, hi in zip(vs, vs[1:]):
            left = [r for r in rows if r[0][f] <= lo]
            wl, sl = sum(r[2] for r in left), sum(r[2] * r[1] for r in left)
            gain = round((sl * sl / wl + (s - sl) ** 2 / (w - wl) - s * s / w) / err, RF.DIGITS)
            if gain > 0 and (out is None or gain > out[0]):
                out = (gain, f, (lo + hi) / 2)
    return out and out[1:]


def predict(rows, x, depth, k):
    split = best(rows, k) if depth else None
    if not split:
        return sum(r[2] * r[1] for r in rows) / sum(r[2] for r in rows)
    f, t = split
    return predict([r for r in rows if (r[0][f] <= t) == (x[f] <= t)], x, depth - 1, k)


@pytest.fixture(scope="module")
def panel(spark):
    random.seed(4)
    rows = []
    for region in ("A", "B", "C"):
        for m in range(20 if region != "C" else 4):
            a, b = random.randint(0, 5), random.choice([0.0, 1.5, 2.5])
            rows.append((region, dt.date(2020 + m // 12, m % 12 + 1, 1), a if m else None, b, float(a * 3 + (b > 1) * 5 + random.randint(0, 2)), 1.0 + m / 10))
    return spark.createDataFrame(rows, "region_id string, month date, a int, b double, y double, importance_weight double"), rows


def test_tree_equals_brute_force(spark, panel):
    df, rows = panel
    got = {(r.region_id, r.month): (r.predicted, r.actual, r.step) for r in RF.predictions(RF.grow(df, ["a", "b"], ["y"], n=6, num_trees=1, max_depth=3, bootstrap=False)).collect()}
    assert {k[0] for k in got} == {"A", "B"} and len(got) == 12         # C has no more rows than the holdout
    for region in "AB":
        own = [r for r in rows if r[0] == region]
        train = [((r[2], r[3]), r[4], r[5]) for r in own[:-6] if r[2] is not None]
        for step, r in enumerate(own[-6:], 1):
            p, y, s = got[region, r[1]]
            assert s == step and y == r[4] and abs(p - predict(train, (r[2], r[3]), 3, 2)) < 1e-9


def test_forest(spark, panel):
    df, rows = panel
    pred, imp = RF.fit_regions(df, ["a", "b"], ["y"], n=6, num_trees=25, max_depth=4)
    got = pred.collect()
    assert len(got) == 12 and all(min(r[4] for r in rows) <= x.predicted <= max(r[4] for r in rows) for x in got)
    assert sum(abs(x.predicted - x.actual) for x in got) / 12 < 4
    total = {}
    for r in imp.collect():
        total[r.region_id, r.target] = total.get((r.region_id, r.target), 0) + r.importance
    assert set(total) == {("A", "y"), ("B", "y")} and all(abs(v - 1) < 1e-9 for v in total.values())
    again = {(r.region_id, r.month): r.predicted for r in RF.fit_regions(df.repartition(3), ["a", "b"], ["y"], n=6, num_trees=25, max_depth=4)[0].collect()}
    assert all(abs(again[x.region_id, x.month] - x.predicted) < 1e-9 for x in got)


def test_one_exchange_for_all_levels(spark, panel):
    """Deeper trees add no shuffle."""
    df, _ = panel
    plans = [RF.grow(df, ["a", "b"], ["y"], num_trees=2, max_depth=d)._jdf.queryExecution().toString().split("== Physical Plan ==")[1] for d in (1, 4)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")
