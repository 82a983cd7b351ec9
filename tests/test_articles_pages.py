"""Goldens G9, G10, G12, G13; page text; stream dedupe."""

import json
import os

from pyspark.sql import functions as F

from sparkcast.operators import articles as AR, pages as PG
from sparkcast.sources import readers

TESTING_CONFIG = {"testing": {
    "years": ["2024", "2021", "2015", "2014", "2011", "2010"],
    "searches": ["[metric] in [country] in [year]"],
    "countries": {"Honduras": "HN"},
    "metrics": ["war", "coup", "election", "economic crisis", "ethnic tension", "natural disaster"]}}


def test_g9_search_grid(spark, tmp_dir):
    path = os.path.join(tmp_dir, "io.json")
    with open(path, "w") as f:
        json.dump(TESTING_CONFIG, f)
    t, c, m, y = readers.config_axes(readers.read_search_config(spark, path))
    g = AR.search_grid(t, c, m, y).orderBy("query_seq").collect()
    assert len(g) == 36
    assert g[0].search == "war in Honduras in 2024"
    assert g[6].search == "coup in Honduras in 2024"
    assert g[0].country_code == "HN"


def test_g13_first_seen(spark):
    hits = spark.createDataFrame([(1, 1, "u1"), (1, 2, "u2"), (2, 1, "u2"), (2, 2, "u3")],
                                 "query_seq int, hit_seq int, url string")
    visited = spark.createDataFrame([("u3",)], "url string")
    got = {r.url: r.query_seq for r in AR.first_seen(hits, ["query_seq", "hit_seq"], visited=visited).collect()}
    assert got == {"u1": 1, "u2": 1}
    top = AR.top_k_hits(hits, 1, ["query_seq"], ["hit_seq"]).collect()
    assert sorted((r.query_seq, r.url) for r in top) == [(1, "u1"), (2, "u2")]


def test_g10_occurrence_matrix(spark):
    rows = spark.createDataFrame([
        ("Kenya", "coup", ["08-2022", "September-2023"]),
        ("Kenya", "election", ["August-2022"]),
        ("Kenya", "economic crisis", ["09-2023", "December-2023"]),
        ("Uganda", "coup", ["January-2023"]),
        ("Uganda", "economic crisis", ["March-2023", "07-2023"])], "country string, metric string, dates array<string>")
    cells = PG.occurrence_cells(rows, ["coup", "election", "economic crisis"])
    assert cells.select("month").distinct().count() == 17
    ones = {(r.metric, r.country, r.month_label) for r in cells.where("present = 1").collect()}
    assert ones == {("coup", "Kenya", "08-2022"), ("coup", "Kenya", "09-2023"), ("coup", "Uganda", "01-2023"),
                    ("election", "Kenya", "08-2022"), ("economic crisis", "Kenya", "09-2023"),
                    ("economic crisis", "Kenya", "12-2023"), ("economic crisis", "Uganda", "03-2023"),
                    ("economic crisis", "Uganda", "07-2023")}
    assert cells.count() == 3 * 2 * 17
    wide = PG.matrix_wide(cells)
    assert len(wide.columns) == 2 + 17 and wide.count() == 6


def test_g12_answer_rows(spark):
    ans = spark.createDataFrame([(1, "No "), (2, "yes\nKenya, coup, 08-2022, 09-2023")], "id int, text string")
    r = PG.answer_rows(ans, keys=["id"]).collect()
    assert len(r) == 1
    assert (r[0].id, r[0].country, r[0].metric, r[0].dates) == (2, "Kenya", "coup", ["08-2022", "09-2023"])


def test_page_blocks_script_trap(spark):
    html = ('<html><head><script>var t="</p>";</script><style>p{}</style></head><body>'
            '<p>short</p><p class="x">This paragraph is long enough to be kept &amp; decoded.</p>'
            '<ul><li>Another list item that is clearly longer than thirty.</li></ul></body></html>')
    df = spark.createDataFrame([(1, html), (2, "<p>tiny</p>")], "id int, html string")
    got = {r.id: r.t for r in df.select("id", PG.page_blocks("html").alias("t")).collect()}
    assert got[1] == ("This paragraph is long enough to be kept & decoded.\n"
                      "Another list item that is clearly longer than thirty.")
    assert got[2] is None
    fb = df.select(PG.page_fallback("html", min_len=20).alias("f")).collect()
    assert fb[0].f.source == "body" and fb[1].f.source is None


def test_parse_month_formats(spark):
    df = spark.createDataFrame([("08-2022",), ("August-2022",), ("2022-08",), ("2023",), ("junk",)], "s string")
    got = [r.m for r in df.select(PG.parse_month("s").alias("m")).collect()]
    assert [g.isoformat() if g else None for g in got] == ["2022-08-01"] * 3 + [None, None]


def test_stream_dedupe(spark, tmp_dir):
    from sparkcast.streaming.dedupe import dedupe_stream, first_seen_batches
    src = os.path.join(tmp_dir, "landing")
    df = spark.createDataFrame([("u1", 1, 1), ("u2", 1, 2), ("u2", 2, 1), ("u3", 2, 2), ("u1", 3, 1)],
                               "url string, query_seq int, hit_seq int")
    df.write.parquet(src)
    out = dedupe_stream(spark, src, df.schema, url="url")
    assert spark.read.parquet(out).select("url").distinct().count() == spark.read.parquet(out).count() == 3
    vis = first_seen_batches(spark, src, df.schema, ["query_seq", "hit_seq"], url="url")
    got = {r.url: r.query_seq for r in spark.read.parquet(vis).collect()}
    assert got == {"u1": 1, "u2": 1, "u3": 2}


def test_prompts(spark):
    a = spark.createDataFrame([("Kenya", "x" * 20000)], "country string, full_text string")
    for cut, size in ((None, 20000), (16000, 16000)):
        p = PG.prompts(a, "Report [all metrics] for [country].", F.array(F.lit("coup"), F.lit("war")), max_chars=cut)
        t = p.first().prompt
        assert t.startswith("Report coup, war for Kenya. ") and len(t) == len("Report coup, war for Kenya. ") + size


def test_q17_no_valid_dates_raises(spark):
    import pytest
    rows = spark.createDataFrame([("Kenya", "coup", ["2023", "junk"])], "country string, metric string, dates array<string>")
    with pytest.raises(ValueError):
        PG.occurrence_cells(rows, ["coup"])


def test_occurrence_report(spark):
    rows = spark.createDataFrame([("Kenya", "coup", ["08-2022", "2023"]), ("Chad", "war", ["junk"])],
                                 "country string, metric string, dates array<string>")
    cl = spark.createDataFrame([("Kenya",)], "country string")
    r = PG.occurrence_report(rows, cl).first()
    assert (r.unparsed_dates, r.rows_outside) == (2, 1)


def test_t3_best_text_and_u5(spark):
    df = spark.createDataFrame([("x" * 1001, "<p>" + "y" * 40 + "</p>"), ("short", "<p>" + "z" * 40 + "</p>")],
                               "extracted string, html string")
    got = [r.t for r in df.select(PG.best_text(F.col("extracted"), F.col("html")).alias("t")).collect()]
    assert got == ["x" * 1001, "z" * 40]
    visited = spark.createDataFrame([("u1",)], "url string")
    new = spark.createDataFrame([("u2", 1), ("u1", 2)], "url string, q int")
    assert sorted(r.url for r in AR.visited_after(visited, new).collect()) == ["u1", "u2"]


def test_f3_f17_helpers(spark):
    from sparkcast.functions.text import file_label, fill_placeholders
    df = spark.createDataFrame([("[metric] in [country] in [year]", "Kenya", "coup", "2024", "a/b c:d")],
                               "t string, c string, m string, y string, name string")
    r = df.select(fill_placeholders(F.col("t"), {"country": F.col("c"), "metric": F.col("m"),
                                                  "year": F.col("y")}).alias("s"),
                  file_label("name").alias("f")).first()
    assert (r.s, r.f) == ("coup in Kenya in 2024", "a_b_c_d")


def test_month_of_event_dates(spark):
    from sparkcast.operators.panel import month_of
    df = spark.createDataFrame([("03 July 2025",), ("3 July 2025",), ("bad",)], "d string")
    got = [r.m for r in df.select(month_of("d", "d MMMM yyyy").alias("m")).collect()]
    assert [g.isoformat() if g else None for g in got] == ["2025-07-01", "2025-07-01", None]


def test_stream_dedupe_within_watermark(spark, tmp_dir):
    import datetime as dt
    from sparkcast.streaming.dedupe import dedupe_stream
    src = os.path.join(tmp_dir, "landing_ts")
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("u1", t0), ("u1", t0 + dt.timedelta(hours=1)), ("u2", t0)],
                               "url string, published timestamp")
    df.write.parquet(src)
    out = dedupe_stream(spark, src, df.schema, url="url", event_time="published", delay="1 day")
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u1", "u2"]


def test_strip_matches_python_whitespace(spark):
    s = "   \x1c text 　\n "
    got = spark.createDataFrame([(s,)], "s string").select(PG.strip_ws(F.col("s")).alias("t")).first().t
    assert got == s.strip()
