"""Edge cases: empty edge table, explicit country list, per-query limit
before first-seen, null pages."""

import datetime as dt

from pyspark.sql import functions as F

from sparkcast.operators import articles as AR, pages as PG, panel


def test_panel_without_edges(spark):
    ev = spark.createDataFrame([("A", dt.date(2020, 1, 1), "x", "s"), ("B", dt.date(2020, 2, 1), "x", "s")],
                               "region_id string, month date, event_type string, sub_event_type string")
    edges = spark.createDataFrame([], "region_id string, neighbour_id string")
    p = panel.build_panel(ev, edges, "event_type", ["x"], "sub_event_type", ["s"], base_year=2020)
    rows = p.collect()
    assert len(rows) == 4 and all(r.x_neighbours == 0 for r in rows)


def test_occurrence_with_country_list(spark):
    rows = spark.createDataFrame([("Kenya", "coup", ["01-2020", "03-2020"]), ("Chad", "coup", ["02-2020"])],
                                 "country string, metric string, dates array<string>")
    cl = spark.createDataFrame([("Kenya",), ("Peru",)], "country string")
    cells = PG.occurrence_cells(rows, ["coup"], countries=cl)
    assert {r.country for r in cells.collect()} == {"Kenya", "Peru"}      # Chad dropped, Peru all zeros
    assert cells.where("country = 'Peru'").agg(F.sum("present")).first()[0] == 0
    assert cells.select("month").distinct().count() == 3                   # range still from all rows


def test_first_seen_after_per_query_limit(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "c"), (2, 2, "d")],
                                 "query_seq int, hit_seq int, url string")
    got = {r.url: r.query_seq for r in AR.first_seen(hits, ["query_seq", "hit_seq"], max_results=2,
                                                     query=["query_seq"]).collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 2}    # "c" was query 1's third hit, cut by the limit


def test_null_page(spark):
    df = spark.createDataFrame([(1, None)], "id int, html string")
    r = df.select(PG.page_blocks("html").alias("b"), PG.page_fallback("html").alias("f")).first()
    assert r.b is None and r.f.text is None


def test_payload_directory_with_empty_response(spark, tmp_dir):
    import json
    import os
    from sparkcast.sources import readers
    d = os.path.join(tmp_dir, "payloads")
    os.makedirs(d)
    with open(os.path.join(d, "empty.json"), "w") as f:
        json.dump([{"message": [{"id": "120", "value": "Invalid value"}]}, None], f)
    with open(os.path.join(d, "infl.json"), "w") as f:
        json.dump([{"page": 1}, [{"indicator": {"id": "FP.CPI.TOTL.ZG", "value": "Inflation"},
                                  "country": {"id": "KE", "value": "Kenya"}, "countryiso3code": "KEN",
                                  "date": "2020", "value": 5.2}]], f)
    rows = readers.read_payload_rows(spark, d)
    assert rows.count() == 1 and rows.first().countryiso3code == "KEN"


def test_pooled_fit_without_training_rows(spark):
    import pytest
    from sparkcast.operators import forecast
    df = spark.createDataFrame([("A", dt.date(2020, k, 1), 1.0, 0.0) for k in range(1, 5)],
                               "region_id string, month date, y double, `y (t-1)` double")
    with pytest.raises(ValueError):
        forecast.fit_pooled(df, ["y (t-1)"], ["y"], n=6, num_trees=3, weight=None)


def test_session_helpers(spark):
    from sparkcast.session import spread
    par = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == par
    many = spark.range(100).repartition(par + 3)
    assert spread(many).rdd.getNumPartitions() == par + 3          # enough splits: untouched


def test_intermediates_are_dropped(spark):
    import os
    from sparkcast.session import _written, drop_intermediates, materialize
    drop_intermediates()
    assert materialize(spark.range(3)).count() == 3 and len(_written) == 1
    path = _written[0].removeprefix("file:")
    assert os.path.isdir(path) and drop_intermediates() == 1 and not os.path.exists(path)
