"""First-seen over a stream: order, restarts, visited set, expiry, cost a batch."""

import datetime as dt
import os

import pytest
from sparkcast.streaming.first_seen import first_seen_stream

SCHEMA = "url string, q int, h int, at timestamp, note string"


def land(spark, src, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture()
def run(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))

    def go(rows, **how):
        land(spark, src, rows)
        first_seen_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, ["q", "h"], out=out, checkpoint=ck, **how)
        return sorted((r.url or "", r.q if r.q is not None else -1, r.h, r.note) for r in spark.read.schema(SCHEMA).parquet(out).collect())
    return go


def test_order_and_restart(spark, run):
    got = run([("u1", 2, 1, day(0), "x"), ("u1", 1, 5, day(0), "first"), ("u2", 1, 1, day(0), "b"), ("u2", 1, 1, day(0), "a"), (None, 3, 1, day(0), "null"), ("u4", None, 9, day(0), "n"),
               ("u4", 0, 1, day(0), "later"), ("old", 1, 1, day(0), "gone")], visited=spark.createDataFrame([("old",)], "url string"))
    want = [("", 3, 1, "null"), ("u1", 1, 5, "first"), ("u2", 1, 1, "a"), ("u4", -1, 9, "n")]
    assert got == want
    # what comes later never replaces an earlier batch, though its order is smaller
    assert run([("u1", 0, 0, day(1), "too late"), ("u9", 7, 7, day(1), "new")] * 3) == sorted([*want, ("u9", 7, 7, "new")])


def test_expiry(run):
    assert len(run([("u1", 1, 1, day(0), "a")], event_time="at", keep="3 days")) == 1
    assert len(run([("u1", 1, 1, day(1), "b"), ("u2", 1, 1, day(20), "c")], event_time="at", keep="3 days")) == 2
    assert len(run([("u3", 1, 1, day(21), "d")], event_time="at", keep="3 days")) == 3
    got = run([("u1", 1, 1, day(22), "again")], event_time="at", keep="3 days")
    assert [x[3] for x in got if x[0] == "u1"] == ["a", "again"]


def test_bad_spans(spark):
    with pytest.raises(ValueError):
        first_seen_stream(spark, "/nowhere", spark.createDataFrame([], SCHEMA).schema, ["q"], keep="3 days")
