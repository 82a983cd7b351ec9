"""Base and increments equal the full build; only what an increment touches is read."""

import datetime as dt
import os
import random

import pytest
from sparkcast.operators.incremental import PanelStore
from sparkcast.operators.panel import build_panel

SCHEMA = "region_id string, month date, kind string, sub string"
KINDS, SUBS = ["x", "y"], ["s"]


def month(k):
    return dt.date(2018 + k // 12, k % 12 + 1, 1)


def rows_of(df):
    return sorted((tuple(str(r[x]) for x in sorted(df.columns))) for r in df.collect())


@pytest.mark.parametrize("lag", [1, 2])
def test_increments_equal_full_build(spark, tmp_dir, lag):
    random.seed(lag)
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C"), ("C", "B")], "region_id string, neighbour_id string")
    ev = lambda months, regions, n: [(random.choice(regions), month(random.choice(months)), random.choice(KINDS), random.choice(["s", "t", None])) for _ in range(n)]
    base = ev([k for k in range(30) if k not in (7, 8)], ["A", "B", None], 400)
    steps = [base, ev([30, 31], ["A", "B"], 20), ev([7], ["A", None], 5), ev([3, 29], ["B"], 6), ev([12], ["C"], 3), [], [(None, month(40), "x", "s")], [("A", None, "x", "s")]]
    store = PanelStore(spark, os.path.join(tmp_dir, f"panel{lag}"), edges, "kind", KINDS, "sub", SUBS, lag)
    done, told = [], []
    for k, rows in enumerate(steps):
        done += rows
        told.append(store.update(spark.createDataFrame(rows, SCHEMA), k))
        if k in (3, 6):
            told.append(store.update(spark.createDataFrame(rows, SCHEMA), k))       # the same batch again
        if k in (0, 2, 4, 7):
            full = build_panel(spark.createDataFrame([r for r in done if r[1]], SCHEMA), edges, "kind", KINDS, "sub", SUBS, lag=lag)
            assert rows_of(store.read()) == rows_of(full.select(*store.read().columns))
    assert told[1]["touched"] == [month(30), month(31)] and told[1]["made"] == [month(30), month(31)]
    assert told[2]["made"] == [month(k) for k in (7, 9, 10)[:lag + 1]]
    assert told[1]["rows_read"] < told[0]["rows_read"] / 4 and told[2]["rows_read"] < told[0]["rows_read"] / 4
    assert len(told[5]["made"]) == 31 and told[6] == {"touched": [], "made": [], "rows_read": 0}


def test_nothing_stored(spark, tmp_dir):
    edges = spark.createDataFrame([], "region_id string, neighbour_id string")
    with pytest.raises(ValueError):
        PanelStore(spark, os.path.join(tmp_dir, "none"), edges, "kind", KINDS, "sub", SUBS).read()
