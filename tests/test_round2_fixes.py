"""Readers by name and without loss, first-seen streams, search grid tasks,
merged regions, page text and dates."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkcast.operators import adjacency as A, articles as AR, indicators as I, pages as PG
from sparkcast.operators.model_table import build_model_table
from sparkcast.sources import readers, sinks


def test_events_by_header_name(spark, tmp_dir):
    path = os.path.join(tmp_dir, "events.csv")
    with open(path, "w") as f:
        f.write("notes,event_type,admin1,country,event_id_cnty,event_date,year,fatalities,sub_event_type\n")
        f.write("x,Battles,Donetsk,Ukraine,UKR1,03 July 2025,2025,3,Armed clash\n")
        f.write("y,Riots,Kyiv,Ukraine,UKR2,1 May 2019,not a year,0,Mob violence\n")
    rows = readers.read_events(spark, path, start_year=None).orderBy("event_id_cnty").collect()
    assert [(r.year, r.admin1, r.event_type) for r in rows] == [(2025, "Donetsk", "Battles"), (None, "Kyiv", "Riots")]
    assert readers.read_events(spark, path).count() == 1
    with open(path, "w") as f:
        f.write("year,country\n2025,Ukraine\n")
    with pytest.raises(ValueError, match="admin1"):
        readers.read_events(spark, path)


def test_articles_round_trip_loses_nothing(spark, tmp_dir):
    df = spark.createDataFrame([(f"t{i}", f"https://x.example/{i}") for i in range(10)], "title string, url string")
    path = os.path.join(tmp_dir, "articles")
    sinks.write_articles(df.repartition(1), path)
    assert readers.read_articles(spark, path).count() == 10


def test_payload_values_and_order(spark, tmp_dir):
    row = lambda v, year: {"indicator": {"id": "G", "value": "Gini"}, "country": {"id": "AA", "value": "Aland"},
                           "countryiso3code": "AAA", "date": year, "value": v}
    for name, rows in (("a", [row(1.5, "2011"), row(None, "2011"), row("n/a", "2012")]), ("b", [row("2.5", "2011")])):
        with open(os.path.join(tmp_dir, f"{name}.json"), "w") as f:
            json.dump([{"page": 1}, rows], f)
    long = I.flatten_observations(readers.read_payload_rows(spark, tmp_dir, seq="seq"), "G", seq="seq")
    assert sorted((r.year, r.value) for r in long.collect() if r.value is not None) == [(2011, 1.5), (2011, 2.5)]
    assert long.count() == 3
    wide = I.wide_table(long, {"gini": "G"}, [2011, 2012], seq="seq").first()
    assert wide.gini_2011 == 1.5 and wide.gini_2012 is None


def test_load_or_build_shows_other_faults(spark, tmp_dir):
    path = os.path.join(tmp_dir, "broken")
    os.makedirs(path)
    with open(os.path.join(path, "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        readers.load_or_build(spark, path, lambda: spark.range(1)).count()
    assert os.listdir(path) == ["part-0.parquet"]


def test_first_seen_over_two_streams(spark, tmp_dir):
    from sparkcast.streaming.dedupe import first_seen_batches
    schema = "url string, query_seq int, hit_seq int"
    visited = os.path.join(tmp_dir, "visited")
    for k, rows in enumerate(([("u1", 1, 1), ("u2", 1, 2)], [("u1", 5, 1), ("u9", 5, 2), ("u9", 6, 1)])):
        src = os.path.join(tmp_dir, f"landing{k}")
        for r in rows:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(src)
        got = first_seen_batches(spark, src, spark.createDataFrame([], schema).schema, ["query_seq", "hit_seq"], visited_path=visited, max_files_per_trigger=1)
    seen = sorted((r.url, r.query_seq) for r in spark.read.parquet(got).collect())
    assert [u for u, _ in seen] == ["u1", "u2", "u9"] and seen[0] == ("u1", 1) and seen[1] == ("u2", 1)


def test_search_grid_is_made_in_several_tasks(spark):
    def axis(n, names, value):
        return spark.createDataFrame([(i, f"{value}{i}", f"code{i}") for i in range(n)], "o int, v string, c string").select(*names)
    g = AR.search_grid(axis(2, [F.col("o").alias("t_ord"), F.concat(F.col("v"), F.lit(" [metric] in [country] [year]")).alias("template")], "t"),
                       axis(5, [F.col("o").alias("c_ord"), F.col("v").alias("country"), F.col("c").alias("code")], "c"),
                       axis(3, [F.col("o").alias("m_ord"), F.col("v").alias("metric")], "m"),
                       axis(4, [(-F.col("o")).alias("y_ord"), F.col("o").alias("year")], "y"))
    rows = sorted(g.collect())
    assert [r.query_seq for r in rows] == list(range(120))
    want = [(f"t{t} m{m} in c{c} {y}", f"c{c}", f"code{c}", f"m{m}", str(y)) for t in range(2) for c in range(5) for m in range(3) for y in (3, 2, 1, 0)]
    assert [tuple(r)[1:] for r in rows] == want
    assert g.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def _square(x, y):
    return [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y))]]


BOUNDS = "adm0_a3 string, name_en string, name string, name_alt string, rings array<array<struct<x:double,y:double>>>, pos long"


@pytest.fixture()
def bounds(spark):
    """Ain | Allier | Geneva in a row, Calvados far off, two Libyan districts and Cairo."""
    return spark.createDataFrame([("FRA", "Ain", "Ain loc", "Ainalt", _square(0, 0), 1), ("FRA", "Allier", None, None, _square(1, 0), 2),
                                  ("CHE", "Geneva", None, None, _square(2, 0), 3), ("FRA", "Calvados", None, None, _square(9, 9), 4),
                                  ("LBY", "Ghat", None, None, _square(20, 0), 5), ("LBY", "Sabha", None, None, _square(21, 0), 6),
                                  ("EGY", "Cairo", None, None, _square(22, 0), 7), ("NPL", "Old", None, None, _square(30, 0), 8)], BOUNDS)


def test_merged_regions(spark, bounds):
    b = A.prepare_boundaries(bounds, country_col="adm0_a3")
    rows = {(r.adm0_a3, r.name_en): r for r in b.collect()}
    parent = rows["FRA", "Auvergne-Rhone-Alpes"]
    assert parent.name is None and parent.name_alt is None and len(parent.rings) == 2 and parent.pos > 8
    assert ("LBY", "Ghat") not in rows and ("FRA", "Ain") in rows
    ids = b.select(F.concat("adm0_a3", F.lit(" - "), "name_en").alias("region_id"), "rings")
    edges = {(r.region_id, r.neighbour_id) for r in A.edges_from_rings(ids, overlaps=A.parent_pairs(spark)).collect()}
    arA = "FRA - Auvergne-Rhone-Alpes"
    assert (arA, "CHE - Geneva") in edges and ("CHE - Geneva", arA) in edges and ("FRA - Ain", "FRA - Allier") in edges
    assert (arA, "FRA - Ain") not in edges and ("FRA - Allier", arA) not in edges
    south = [r for r in rows if r[0] == "LBY"]
    assert len(south) == 1 and (f"LBY - {south[0][1]}", "EGY - Cairo") in edges


@pytest.mark.parametrize("second", [False, True])
def test_build_model_table_end_to_end(spark, bounds, second):
    events = spark.createDataFrame(
        [("FRA1", "France", "Ain"), ("FRA2", "France", "Allier"), ("CHE1", "Switzerland", "Geneva"), ("EGY1", "Egypt", "Cairo"), ("NPL1", "Nepal", "Koshi"),
         ("FRA3", "France", "Auvergne-Rhone-Alpes")], "event_id_cnty string, country string, admin1 string").withColumns(
        {"event_date": F.lit("3 July 2020"), "year": F.lit(2020), "event_type": F.lit("Battles"), "sub_event_type": F.lit("Armed clash")})
    events = events.withColumn("month", F.to_date(F.lit("2020-07-01")))
    events = events.unionByName(events.filter("event_id_cnty = 'EGY1'").withColumn("month", F.to_date(F.lit("2020-08-01"))))
    other = spark.createDataFrame([("NPL", "Koshi", _square(30, 0))], "adm0_a3 string, name_en string, rings array<array<struct<x:double,y:double>>>") if second else None
    rows = {r.region_id: r for r in build_model_table(events, bounds, other).filter("month = '2020-08-01'").collect()}
    merged = rows["FRA - Auvergne-Rhone-Alpes"]
    assert merged["Battles (t-1)"] == 1 and merged["Battles_neighbours (t-1)"] == 1
    assert rows["CHE - Geneva"]["Battles_neighbours (t-1)"] == 2    # Allier and the merged region
    assert ("NPL - Koshi" in rows) == second


def test_page_blocks_nest_and_decode(spark):
    pages = ["<p>one &eacute;&#233;&#xe9; &lt;x&gt;</p><!-- <p>hidden paragraph</p> --><script>'<p>no</p>'</script>",
             "<ul><li>outer <p>inner para</p> tail<ul><li>deep</li></ul>end</li><li>second", "<p>first<p>second <b>bold</b></div>", "", "no blocks", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r.i: r.t for r in df.select("i", PG.page_blocks("html", min_len=2).alias("t")).collect()}
    assert got[0] == "one ééé <x>"
    assert got[1].split("\n") == ["outer inner para taildeepend", "inner para", "deep", "second"]
    assert got[2] == "first\nsecond bold" and got[3] is None and got[4] is None and got[5] is None


@pytest.mark.parametrize("s", ["Sep 2023", "09/2023", "5 Sep 2023", "September 5, 2023", "2023-09-05T10:00:00", "2023/09/05", "9-2023",
                               "Tue, 05 Sep 2023 10:00:00 GMT", "sept 2023", "5th of September 2023", "2023-09-05 10:00:00+02:00", "09/05/2023",
                               "25.09.2023", "20230905", "2023 September", "SEPTEMBER-2023", "2023-09"])
def test_dates(spark, s):
    assert str(spark.createDataFrame([(s,)], "s string").select(PG.parse_month("s")).first()[0]) == "2023-09-01"


def test_not_dates(spark):
    df = spark.createDataFrame([(x,) for x in ("2023", "junk", "", "13-2023", "Smarch 2023", None)], "s string")
    assert df.filter(PG.parse_month("s").isNotNull()).count() == 0


def test_restrict_by_time_country_and_language(spark):
    rows = [("https://a.example/1", "Mon, 01 Jan 2024 10:00:00 GMT", "Kenya", "en"), ("https://a.example/2", "02 Feb 2024 10:00:00 GMT", "Kenya", "fr"),
            ("https://a.example/3", "not a date", "Kenya", "en"), ("https://a.example/4", "Sun, 03 Mar 2024 00:00:00 +0200", "Mali", "en"), ("https://a.example/5", None, None, None)]
    df = spark.createDataFrame(rows, "url string, `published date` string, country string, language string")
    got = lambda **k: sorted(r.url[-1] for r in AR.restrict(df, **k).collect())
    assert got(start="2024-01-15") == ["2", "4"] and got(end="2024-02-02 10:00:00") == ["1"]
    assert got(countries=["Mali"], languages=["en"]) == ["4"] and got(languages=["en"]) == ["1", "3", "4"] and got() == ["1", "2", "3", "4", "5"]
