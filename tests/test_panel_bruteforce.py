"""build_panel against a pandas computation of the same rules on random
events: null regions, months with gaps, islands, listed sub-types."""

import datetime as dt
import math
import random

import pandas as pd
import pytest

from sparkcast.operators import panel


@pytest.mark.parametrize("seed", [3, 4])
def test_build_panel_random(spark, seed):
    rnd = random.Random(seed)
    regions = ["A", "B", "C", "D", "E"]
    months = sorted({dt.date(2019 + rnd.randint(0, 2), rnd.randint(1, 12), 1) for _ in range(9)})
    types, subs, listed = ["x", "y"], ["s1", "s2", "s3"], ["s1", "s3"]
    ev = [(rnd.choice(regions + [None]), rnd.choice(months), rnd.choice(types), rnd.choice(subs))
          for _ in range(300)]
    pairs = {(a, b) for a in regions for b in regions if a < b and rnd.random() < 0.4}
    edges = sorted(pairs | {(b, a) for a, b in pairs})
    got_df = panel.build_panel(
        spark.createDataFrame(ev, "region_id string, month date, event_type string, sub_event_type string"),
        spark.createDataFrame(edges or [("A", "B")], "region_id string, neighbour_id string") if edges else
        spark.createDataFrame([], "region_id string, neighbour_id string"),
        "event_type", types, "sub_event_type", listed, lag=1, decay=0.05, base_year=2019)
    got = {(r.region_id, r.month): r.asDict() for r in got_df.collect()}

    df = pd.DataFrame(ev, columns=["r", "m", "t", "s"])
    axis = sorted(df["m"].unique())
    regs = sorted(df["r"].dropna().unique())
    nbrs = {a: [b for x, b in edges if x == a] for a in regs}
    cnt = df.dropna(subset=["r"]).groupby(["r", "m", "t"]).size().to_dict()
    scnt = df.dropna(subset=["r"]).groupby(["r", "m", "s"]).size().to_dict()
    latest = max(axis)
    assert len(got) == len(regs) * len(axis)
    for r in regs:
        prev = None
        for m in axis:
            row = got[(r, m)]
            want = {t: cnt.get((r, m, t), 0) for t in types}
            want.update({s: scnt.get((r, m, s), 0) for s in listed})
            want.update({f"{t}_neighbours": sum(cnt.get((n, m, t), 0) for n in nbrs[r]) for t in types})
            for k, v in want.items():
                assert row[k] == v, (r, m, k)
                assert row[f"{k} (t-1)"] == (prev[k] if prev else None), (r, m, k)
            assert row["linear_month_trend"] == (m.year - 2019) * 12 + m.month - 1
            months_since = (latest.year - m.year) * 12 + latest.month - m.month
            assert math.isclose(row["importance_weight"], math.exp(-0.05 * months_since), rel_tol=1e-12)
            prev = want
