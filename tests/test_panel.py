"""Goldens G1-G4 (FIXTURES.md) and panel invariants."""

import datetime as dt
import math

from pyspark.sql import functions as F

from sparkcast.operators import forecast, panel


def d(s):
    y, m = s.split("-")
    return dt.date(int(y), int(m), 1)


def _events(spark):
    rows = [("B", "2024-03", "x"), ("A", "2024-01", "y"), (None, "2024-02", "x"),
            ("A", "2024-03", "x"), ("B", "2024-01", "z")]
    return spark.createDataFrame([(r, d(m), t) for r, m, t in rows],
                                 "region_id string, month date, event_type string")


def test_g1_zero_fill_and_lag(spark):
    p = panel.monthly_counts(_events(spark), "event_type", ["x", "y", "z"])
    got = {(r.region_id, r.month.strftime("%Y-%m")): (r.x, r.y, r.z) for r in p.collect()}
    assert len(got) == 6  # 2 regions x 3 months; the null region is left out
    assert got[("A", "2024-01")] == (0, 1, 0)
    assert got[("A", "2024-02")] == (0, 0, 0)   # month only seen on the unmatched row
    assert got[("A", "2024-03")] == (1, 0, 0)
    assert got[("B", "2024-01")] == (0, 0, 1)
    assert got[("B", "2024-02")] == (0, 0, 0)
    assert got[("B", "2024-03")] == (1, 0, 0)
    lagged = panel.add_lags(p, ["x", "y", "z"]).where(F.col("region_id") == "A").orderBy("month").collect()
    assert lagged[0]["y (t-1)"] is None
    assert lagged[1]["y (t-1)"] == 1


def test_g2_neighbour_sums(spark):
    ev = spark.createDataFrame([("A", d("2024-01"), "x")] * 2 + [("B", d("2024-01"), "x")] * 3 +
                               [("C", d("2024-01"), "x")] * 5, "region_id string, month date, event_type string")
    edges = spark.createDataFrame([("A", "B"), ("B", "A")], "region_id string, neighbour_id string")
    counts = panel.event_counts(ev, "event_type")
    nb = {r.region_id: r.x_neighbours for r in panel.neighbour_sums(counts, edges, "event_type", ["x"]).collect()}
    assert nb == {"A": 3, "B": 2, "C": 0}


def test_g3_trend_and_weight(spark):
    df = spark.createDataFrame([("A", d("2018-01")), ("A", d("2019-03")), ("A", d("2024-01")), ("A", d("2024-03"))],
                               "region_id string, month date")
    out = {r.month.strftime("%Y-%m"): r for r in panel.add_weights(panel.add_trend(df), 0.05).collect()}
    assert out["2018-01"].linear_month_trend == 0
    r = out["2019-03"]
    assert (r.linear_month_trend, r.year, r.month_3, r.month_2) == (14, 2019, 1, 0)
    assert (r.quarter_2, r.quarter_3, r.quarter_4) == (0, 0, 0)
    assert math.isclose(out["2024-01"].importance_weight, math.exp(-0.1), rel_tol=1e-12)
    assert out["2024-03"].importance_weight == 1.0


def test_g4_error_metrics(spark):
    df = spark.createDataFrame([("r", 0.0, 1.0), ("r", 2.0, 1.0), ("r", 4.0, 5.0)],
                               "region_id string, actual double, predicted double")
    m = forecast.error_metrics(df, ["region_id"]).collect()[0]
    assert m.mae == 1.0 and math.isclose(m.mape, 37.5)


def test_holdout_last_six(spark):
    df = spark.createDataFrame([("A", dt.date(2020, k, 1)) for k in range(1, 13)], "region_id string, month date")
    h = forecast.split_holdout(df, 6).collect()
    test = sorted(r.month.month for r in h if r.split == "test")
    assert test == [7, 8, 9, 10, 11, 12]
    assert {r.month.month: r.step for r in h if r.split == "test"}[7] == 1


def test_panel_invariants(spark):
    """Rows = regions x months; counts sum to matched events."""
    ev = _events(spark)
    p = panel.monthly_counts(ev, "event_type", ["x", "y", "z"])
    tot = p.select(F.sum(F.col("x") + F.col("y") + F.col("z"))).first()[0]
    assert tot == ev.where(F.col("region_id").isNotNull()).count()


def test_strict_subevent_values(spark):
    import pytest
    with pytest.raises(KeyError):
        panel.monthly_counts(_events(spark), "event_type", ["x", "nope"], strict=True)
    # non-strict: a listed value absent from the data is a column of zeros (Q18)
    p = panel.monthly_counts(_events(spark), "event_type", ["x", "nope"])
    assert p.select(F.sum("nope")).first()[0] == 0


def test_q10_short_regions_skipped(spark):
    from pyspark.ml.linalg import Vectors  # noqa: F401  (ml import check)
    rows = [("A", dt.date(2020, k, 1), float(k), float(k - 1), 1.0) for k in range(1, 13)]
    rows += [("B", dt.date(2020, k, 1), 1.0, 0.0, 1.0) for k in range(1, 4)]
    df = spark.createDataFrame(rows, "region_id string, month date, y double, `y (t-1)` double, importance_weight double")
    pred, imp = forecast.fit_pooled(df, ["y (t-1)", "importance_weight"], ["y"], n=6, num_trees=5, max_depth=3)
    assert {r.region_id for r in pred.collect()} == {"A"}
    assert [r.region_id for r in forecast.short_regions(df).collect()] == ["B"]


def test_m7_end_to_end(spark, tmp_dir):
    import os
    from sparkcast.operators.adjacency import square_rings
    from sparkcast.operators.model_table import build_model_table
    from sparkcast.operators import fixed_values as FV
    from sparkcast.sources import readers
    csv = os.path.join(tmp_dir, "ev.csv")
    lines = ["year,event_date,event_id_cnty,country,admin1,event_type,sub_event_type"]
    for m, mon in enumerate(["January", "February", "March", "April", "May", "June", "July", "August"]):
        lines.append(f"2019,0{1 + m % 9} {mon} 2019,AAA{m},Aland,Nörth,Battles,Agreement")
        lines.append(f"2019,1{m % 9} {mon} 2019,AAA{m}b,Aland,South Province,Protests,Armed clash")
    lines.append("2017,1 May 2017,AAA99,Aland,North,Riots,Mob violence")      # before the start year
    lines.append("2019,1 May 2019,AAA98,Aland,Nowhere Land,Riots,Mob violence")  # unmatched
    open(csv, "w").write("\n".join(lines) + "\n")
    ev = readers.read_events(spark, csv)
    cells = spark.createDataFrame([("North", 0, 0, 0), ("South", 1, 0, 1), ("Island", 5, 5, 2)],
                                  "name_en string, x int, y int, pos long")
    rings = square_rings(cells, "name_en", "x", "y").withColumnRenamed("region_id", "name_en")
    b = (cells.join(rings, "name_en")
         .select(F.lit("AAA").alias("adm0_a3"), "name_en", F.lit(None).cast("string").alias("name"),
                 F.lit(None).cast("string").alias("name_alt"), "rings", "pos"))
    mt = build_model_table(ev, b)
    assert mt.columns[:2] == ["region_id", "month"]
    assert mt.columns[2:2 + len(FV.PREDICTORS)] == FV.PREDICTORS
    rows = mt.collect()
    assert {r.region_id for r in rows} == {"AAA - North", "AAA - South"}
    assert len(rows) == 2 * 8
    north_feb = [r for r in rows if r.region_id == "AAA - North" and r.month.month == 2][0]
    assert north_feb["Battles (t-1)"] == 1 and north_feb["Protests_neighbours (t-1)"] == 1


def test_p5_empty_list_means_all(spark):
    p = panel.monthly_counts(_events(spark), "event_type", [])
    assert [c for c in p.columns if c not in ("region_id", "month")] == ["x", "y", "z"]


def test_m5_one_region_forecast(spark):
    import pytest
    rows = [("A", dt.date(2020, k, 1), float(k % 3), float((k - 1) % 3), 1.0) for k in range(1, 13)]
    df = spark.createDataFrame(rows, "region_id string, month date, y double, `y (t-1)` double, importance_weight double")
    pred, metrics, imp = forecast.forecast(df, "A", "y", ["y (t-1)", "importance_weight"])
    assert sorted(r.step for r in pred.collect()) == [1, 2, 3, 4, 5, 6]
    m = metrics.first()
    assert m.n_test == 6 and m.mae >= 0
    assert abs(sum(r.importance for r in imp.collect()) - 1.0) < 1e-6
    with pytest.raises(KeyError):
        forecast.forecast(df, "nowhere", "y", ["y (t-1)"])
