"""Event files with differing headers, date spellings, excluded sites, observed counts."""

import os
from itertools import product

import pytest
from pyspark.sql import functions as F
from sparkcast.operators import articles as AR, pages as PG
from sparkcast.operators.counts import StageCounts
from sparkcast.sources import readers

HEAD = "year,event_date,event_id_cnty,country,admin1,event_type,sub_event_type"


def write(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_headers_differ(spark, tmp_dir):
    write(tmp_dir, "a.csv", HEAD, '2020,03 July 2020,UKR1,Ukraine,"Kyiv, city",Battles,x', "2019,01 May 2019,UKR2,Ukraine,Lviv,Riots,y", "2010,01 May 2010,UKR3,Ukraine,Lviv,Riots,y")
    write(tmp_dir, "b.csv", "﻿extra,event_type,year,event_date,country,event_id_cnty,admin1,sub_event_type", "1,Protests,2021,04 August 2021,Mali,MLI1,Gao,z")
    write(tmp_dir, "c.csv", HEAD)
    write(tmp_dir, "d.csv", HEAD, "n/a,03 July 2020,UKR4,Ukraine,Kyiv,Battles,x", "2020,soon,UKR5,Ukraine,Kyiv,Battles,x", "2020,03 July 2020,UKR6", "2020,03 July 2020,UKR7,Ukraine,Kyiv,Battles,x,more")
    good, bad = readers.read_events_checked(spark, tmp_dir)
    assert sorted((r.event_id_cnty, r.year, str(r.month), r.admin1, r.event_type) for r in good.collect()) == [
        ("MLI1", 2021, "2021-08-01", "Gao", "Protests"), ("UKR1", 2020, "2020-07-01", "Kyiv, city", "Battles"), ("UKR2", 2019, "2019-05-01", "Lviv", "Riots")]
    assert sorted((r.event_id_cnty, r.reason) for r in bad.collect()) == [("UKR4", "year"), ("UKR5", "event_date"), ("UKR6", "cells"), ("UKR7", "cells")]
    everything = readers.read_events_checked(spark, tmp_dir, None)
    assert sum(x.count() for x in everything) == 8              # rows in = rows out + quarantine
    assert readers.read_events(spark, tmp_dir).where("event_id_cnty = 'MLI1'").first().country == "Mali"


def test_missing_header(spark, tmp_dir):
    write(tmp_dir, "a.csv", HEAD, "2020,03 July 2020,UKR1,Ukraine,Kyiv,Battles,x")
    write(tmp_dir, "b.csv", "year,country", "2020,Mali")
    with pytest.raises(ValueError, match="b.csv"):
        readers.read_events(spark, tmp_dir)


def test_two_hundred_spellings(spark):
    """Months by name and number in many orders, separators and year lengths."""
    months = [(2, "February", "Feb"), (9, "September", "Sept"), (11, "November", "nov")]
    days = [(13, "13"), (28, "28th")]
    years = [(1997, "1997"), (2023, "2023"), (2004, "04")]
    spell = []
    for (m, full, short), (d, day), (y, year) in product(months, days, years):
        bare = str(d)
        spell += [(x, f"{y}-{m:02d}-01") for x in (f"{day} {full} {year}", f"{full} {day}, {year}", f"{short} {bare} {year}", f"{bare}-{short}-{year}", f"{bare}/{m}/{year}", f"{m}/{bare}/{year}",
                                                   f"Mon, {bare} {short} {year} 10:30:00 GMT", f"at 10:30 pm, {day} of {full} {year}")]
        if len(year) == 4:
            spell += [(x, f"{y}-{m:02d}-01") for x in (f"{year}-{m:02d}-{bare}", f"{year}{m:02d}{bare}", f"{year} {full} {bare}", f"{full} {year}", f"{m}.{year}", f"{year}/{m}", f"{year}-{m:02d}-{bare}T23:59:59.5+02:00")]
    assert len(spell) >= 200
    df = spark.createDataFrame(spell, "s string, want string").select("s", "want", PG.parse_month("s").cast("string").alias("got"))
    assert df.where("got IS NULL OR got <> want").collect() == []


def test_no_dates(spark):
    bad = ["2023", "", "junk", "Sep", "Sep 23", "Sep Oct 2023", "31 Feb 2023", "13-2023", "2023-13-01", "1 2", "99", "12345 Sep", "5 Sep 123", "a Sep 2023", "1 2 3 4", None]
    assert spark.createDataFrame([(x,) for x in bad], "s string").where(PG.parse_month("s").isNotNull()).collect() == []


def test_excluded_sites(spark):
    urls = ["http://bad.example/x", "https://sub.BAD.example./y", "http://notbad.example/", "http://[broken", "no url", None, "https://fine.org/?u=http://bad.example", "http://user@bad.example:80/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    sites = spark.createDataFrame([(" Bad.example",), ("bad.example",), (None,)], "site string")
    assert sorted(r.i for r in AR.restrict(df, excluded_hosts=sites).collect()) == [2, 3, 4, 5, 6]


def test_observed_counts(spark):
    counts = StageCounts()
    df = counts.observed(spark.range(100), "all")
    df = counts.observed(df.where("id % 4 = 0"), "kept")
    plan = df._jdf.queryExecution().toString()
    assert df.groupBy((F.col("id") % 2).alias("k")).count().count() == 1
    assert [tuple(r) for r in counts.table(spark).collect()] == [("all", 100), ("kept", 25)] and plan.count("Range (0, 100") <= 4
    with pytest.raises(ValueError):
        counts.observed(df, "all")
