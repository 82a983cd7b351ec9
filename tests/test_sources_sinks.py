"""Sources S1-S7 and sinks K1-K5 round trips."""

import json
import os

from pyspark.sql import functions as F

from sparkcast.operators import articles as AR, pages as PG
from sparkcast.sources import readers, sinks


def test_s1_events_csv(spark, tmp_dir):
    path = os.path.join(tmp_dir, "events.csv")
    with open(path, "w") as f:
        f.write("year,event_date,event_id_cnty,country,admin1,event_type,sub_event_type\n")
        f.write("2025,03 July 2025,UKR1,Ukraine,Donetsk,Battles,Armed clash\n")
        f.write("2025,3 July 2025,UKR2,Ukraine,Donetsk,Protests,Agreement\n")
        f.write("2017,1 May 2017,UKR3,Ukraine,Kyiv,Riots,Mob violence\n")
    df = readers.read_events(spark, path, start_year=2018)
    rows = df.collect()
    assert len(rows) == 2
    assert {r.month.isoformat() for r in rows} == {"2025-07-01"}


def test_s2_load_or_build(spark, tmp_dir):
    path = os.path.join(tmp_dir, "panel_start2018_lag1")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert readers.load_or_build(spark, path, build).count() == 3
    assert readers.load_or_build(spark, path, build).count() == 3
    assert len(calls) == 1
    readers.load_or_build(spark, path, build, refresh=True)
    assert len(calls) == 2


def test_k1_k2_tables(spark, tmp_dir):
    df = spark.createDataFrame([("N01", "A", 2010, 1.0, "X", "ind_x")],
                               "countryiso3code string, country_name string, year int, value double, "
                               "indicator_code string, indicator_name string")
    sinks.write_table(df, os.path.join(tmp_dir, "model"))
    assert spark.read.parquet(os.path.join(tmp_dir, "model")).count() == 1
    sinks.write_indicators(df, df.select("countryiso3code"), os.path.join(tmp_dir, "wb"))
    assert os.path.isdir(os.path.join(tmp_dir, "wb", "by_indicator", "indicator_name=ind_x"))
    assert os.path.isdir(os.path.join(tmp_dir, "wb", "combined_indicators"))


def test_s5_k3_k5_articles(spark, tmp_dir):
    arts = [{"title": "Tïtle", "description": "d", "published date": "Mon, 01 Jan 2024 00:00:00 GMT",
             "url": "https://news.example.com/a", "publisher": {"href": "x", "title": "Pub"},
             "country": "Kenya", "search": "coup in Kenya in 2024", "full_text": "text"},
            {"title": "t2", "description": "d", "published date": "Mon, 01 Jan 2024 00:00:00 GMT",
             "url": "https://spam.example.org/b", "publisher": {"href": "x", "title": "Other"},
             "country": "Kenya", "search": "coup in Kenya in 2024", "full_text": None}]
    path = os.path.join(tmp_dir, "articles.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(arts, f, ensure_ascii=False)
    df = readers.read_articles(spark, path, multiline=True)
    assert df.count() == 2
    flat = AR.flatten_record(df)
    assert set(flat.columns) == {"title", "description", "published date", "url", "publisher"}
    ex = spark.createDataFrame([("spam.example.org",)], "host string")
    kept = AR.restrict(df, excluded_hosts=ex)
    assert [r.url for r in kept.collect()] == ["https://news.example.com/a"]
    assert AR.with_text(df).count() == 1
    sinks.write_articles(df, os.path.join(tmp_dir, "out_json"))
    back = spark.read.json(os.path.join(tmp_dir, "out_json"))
    assert "Tïtle" in {r.title for r in back.collect()}
    sinks.write_news_table(flat, os.path.join(tmp_dir, "news_csv"))
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "news_csv")).count() == 2


def test_k4_metric_csvs(spark, tmp_dir):
    rows = spark.createDataFrame([("Kenya", "economic crisis", ["08-2022"]), ("Uganda", "coup", ["09-2022"])],
                                 "country string, metric string, dates array<string>")
    wide = PG.matrix_wide(PG.occurrence_cells(rows, ["coup", "economic crisis"]))
    out = sinks.write_metric_matrices(wide, tmp_dir, run_ts="2024-01-01_00-00-00")
    assert os.path.isdir(os.path.join(out, "metric=economic_crisis"))
    back = spark.read.option("header", True).csv(out)
    assert set(back.columns) >= {"country", "08-2022", "09-2022", "metric"}


def test_p16_tagging(spark):
    hits = spark.createDataFrame([(0, "u1"), (1, "u2")], "query_seq long, url string")
    grid = spark.createDataFrame([(0, "Kenya", "coup in Kenya"), (1, "Chad", "war in Chad")],
                                 "query_seq long, country string, search string")
    got = {r.url: r.country for r in AR.tag_with_query(hits, grid).collect()}
    assert got == {"u1": "Kenya", "u2": "Chad"}


def test_country_metadata(spark, tmp_dir):
    payload = [{"page": 1}, [{"id": "KEN", "name": "Kenya", "iso2Code": "KE", "capitalCity": "Nairobi",
                              "longitude": "36.8", "latitude": "-1.3", "incomeLevel": {"id": "LMC", "value": "Lower"},
                              "region": {"id": "SSF", "value": "Sub-Saharan Africa"}},
                             {"id": "WLD", "name": "World", "iso2Code": "1W", "capitalCity": "", "longitude": "",
                              "latitude": "", "incomeLevel": {"id": "NA", "value": "Aggregates"},
                              "region": {"id": "NA", "value": "Aggregates"}}]]
    path = os.path.join(tmp_dir, "countries.json")
    with open(path, "w") as f:
        json.dump(payload, f)
    from sparkcast.operators import indicators as I
    meta = I.country_metadata(readers.read_payload_rows(spark, path, readers.COUNTRY))
    assert meta.count() == 2
    real = I.real_countries(meta).collect()
    assert [(r.id, r.income_level, r.region_name) for r in real] == [("KEN", "Lower", "Sub-Saharan Africa")]
