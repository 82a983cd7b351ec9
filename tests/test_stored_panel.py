"""The stored panel: its layout makes lags, holdout and one region cheap."""

import datetime
import os
import uuid

import pytest
from pyspark.sql import functions as F
from sparkcast.operators.forecast import split_holdout
from sparkcast.operators.panel import add_lags
from sparkcast.sources.sinks import open_panel, write_panel

COLS = ["Battles", "Riots (all)"]


def panel(spark):
    rows = [(f"R{i}" if i else None, datetime.date(2020 + m // 12, m % 12 + 1, 1), i * m, m - i) for i in range(40) for m in range(15)]
    return spark.createDataFrame(rows, "region_id string, month date, Battles long, `Riots (all)` long")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stored(spark, tmp_dir):
    path = os.path.join(tmp_dir, "panel")
    return write_panel(panel(spark), f"panel_{uuid.uuid4().hex}", path, 8), path


def test_no_exchange_for_lags_and_holdout(spark, stored):
    both = lambda df: split_holdout(add_lags(df, COLS), 6)
    out = both(stored[0])
    assert "Exchange" not in plan(out)
    assert "Exchange" in plan(both(panel(spark)))
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, both(panel(spark)).collect()), key=key)


def test_one_region_reads_one_bucket(spark, stored):
    one = stored[0].where(F.col("region_id") == "R7")
    lags = add_lags(one, COLS)
    assert "SelectedBucketsCount: 1 out of 8" in plan(lags) and "Exchange" not in plan(lags) and lags.count() == 15
    assert len([f for f in os.listdir(stored[1]) if f.endswith(".parquet")]) <= 8


def test_opened_by_another_session(spark, stored):
    again = open_panel(spark.newSession(), f"again_{uuid.uuid4().hex}", stored[1], 8)
    assert again.columns == ["region_id", "month", *COLS] and again.count() == 600
    assert "Exchange" not in plan(add_lags(again, COLS)) and again.where("region_id IS NULL").count() == 15


def test_empty_panel(spark, tmp_dir):
    none = write_panel(panel(spark).limit(0), f"none_{uuid.uuid4().hex}", os.path.join(tmp_dir, "none"), 4)
    assert split_holdout(add_lags(none, COLS)).collect() == []
