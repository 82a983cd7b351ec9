"""Registered queries over landed files (S1, S4, P1, P2, P11-P15, F5, P18, M7) and their SQL.

The event files are written by the query from every order, as two exports whose
columns differ in order and number, and a third with a damaged copy of every
order of one status; they lie in a folder of their own under the shared folder.
Admin names are the nations' (a nation is one region of a country of its own)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..cols import c
from ..operators import articles as AR, indicators as I, panel
from ..operators.adjacency import square_rings
from ..operators.model_table import build_model_table
from ..operators.pages import parse_month
from ..session import materialize, scratch_path
from ..sources import readers
from . import data_queries as DQ, data_sql as DS, panel_queries as PQ, panel_sql as PS, standins as S

EXCLUDED = ["example.net", "Example.org"]

# One spelling a remainder of the order key.
SPELLINGS = ["MM-yyyy", "MMMM-yyyy", "MMM yyyy", "yyyy/MM", "yyyy-MM-dd", "dd MMMM yyyy", "d MMM yy", "MMMM d, yyyy", "MMM d yy", "yyyy MMMM",
             "yyyy.MM.dd", "MM/dd/yyyy", "MM/dd/yy", "yyyyMMdd", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "EEEE d MMMM yyyy 'at' HH:mm", "yyyy-MM-dd'T'HH:mm:ss'Z'",
             "d'th of' MMMM yyyy", "yyyy d MMM", "MMMM yyyy d"]


def _code(key: str):
    return F.concat(F.lit("N"), F.lpad(F.col(key).cast("string"), 2, "0"))


def event_rows(spark, sf_dir) -> DataFrame:
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    cu = S.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = S.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(cu, o.o_custkey == cu.c_custkey, "left").join(na, cu.c_nationkey == na.n_nationkey, "left")
    return j.select("o_orderkey", F.year("o_orderdate").cast("string").alias("year"), F.date_format("o_orderdate", "dd MMMM yyyy").alias("event_date"),
                    F.concat(_code("n_nationkey"), F.col("o_orderkey").cast("string")).alias("event_id_cnty"), F.col("n_name").alias("country"),
                    F.col("n_name").alias("admin1"), F.col("o_orderpriority").alias("event_type"), F.col("o_orderstatus").alias("sub_event_type"))


def write_event_files(spark, sf_dir) -> str:
    """The three exports; returns a path that names all their files."""
    base = scratch_path(spark, f"event_files/{uuid.uuid4().hex}")
    rows = materialize(event_rows(spark, sf_dir))
    names = [f.name for f in readers.EVENT_SCHEMA]
    odd = F.col("o_orderkey") % 2 == 1
    out = lambda df, part: df.write.option("header", True).csv(f"{base}/{part}")
    out(rows.where(~odd).select(*names), "a")
    out(rows.where(odd).select("o_orderkey", *names[::-1]), "b")
    damaged = rows.where("sub_event_type = 'P'").select(F.when(odd, F.lit("n/a")).otherwise(F.col("year")).alias("year"), F.lit("soon").alias("event_date"), *names[2:])
    out(damaged, "c")
    return f"{base}/*"


def event_files(spark, sf_dir) -> DataFrame:
    """Events a month and type, and quarantined rows by reason."""
    good, bad = readers.read_events_checked(spark, write_event_files(spark, sf_dir), S.START_YEAR)
    events = good.groupBy("month", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return events.unionByName(bad.groupBy(F.lit(None).cast("date").alias("month"), F.col("reason").alias("kind")).agg(F.count("*").alias("n")))


def event_files_sql() -> str:
    return f"""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS kind, count(*) AS n FROM orders
WHERE o_orderdate >= TIMESTAMP '{S.START_YEAR}-01-01' GROUP BY 1, 2
UNION ALL SELECT NULL, CASE WHEN o_orderkey % 2 = 1 THEN 'year' ELSE 'event_date' END, count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY 2"""


def model_table_from_files(spark, sf_dir) -> DataFrame:
    """M7 from end to end: event files and boundaries to the model table."""
    events, _ = readers.read_events_checked(spark, write_event_files(spark, sf_dir), S.START_YEAR)
    na = S.table(spark, sf_dir, "nation")
    rings = square_rings(na.select("n_nationkey", F.col("n_regionkey").alias("x"), F.expr("n_nationkey div 5").alias("y")), "n_nationkey", "x", "y")
    bounds = (na.join(rings, na.n_nationkey == rings.region_id)
              .select(_code("n_nationkey").alias("adm0_a3"), F.col("n_name").alias("name_en"), F.lit(None).cast("string").alias("name"),
                      F.lit(None).cast("string").alias("name_alt"), "rings", F.col("n_nationkey").cast("long").alias("pos")))
    out = build_model_table(events, bounds, types=S.EVENT_TYPES, subtypes=S.SUB_EVENT_TYPES, predictors=PQ.predictors(), targets=S.TARGETS,
                            lag=S.LAG, decay=S.DECAY, base_year=S.START_YEAR)
    return panel.model_table(out.withColumn("importance_weight", F.round(c("importance_weight"), PQ.ROUND)), PQ.predictors(), S.TARGETS)


def model_table_from_files_sql() -> str:
    return f"""SELECT 'N' || lpad(CAST(m.region_id AS VARCHAR), 2, '0') || ' - ' || n_name AS region_id, m.* EXCLUDE (region_id)
FROM ({PS.model_table()}) m JOIN nation ON n_nationkey = m.region_id"""


def date_spellings(spark, sf_dir) -> DataFrame:
    """every order's date in one of twenty spellings, back to its month."""
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    style, s = F.col("o_orderkey") % len(SPELLINGS), F.lit(None).cast("string")
    for i, f in enumerate(SPELLINGS):
        s = F.when(style == i, F.date_format("o_orderdate", f)).otherwise(s)
    return o.select(style.alias("style"), parse_month(s).alias("month")).groupBy("style", "month").agg(F.count("*").alias("n"))


def date_spellings_sql() -> str:
    return f"SELECT o_orderkey % {len(SPELLINGS)} AS style, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1, 2"


def article_restricted(spark, sf_dir) -> DataFrame:
    """Pages outside the excluded sites and their subdomains."""
    sites = spark.createDataFrame([(x,) for x in EXCLUDED], "site string")
    return AR.restrict(S.table(spark, sf_dir, "pages").select("page_id", "url"), excluded_hosts=sites).select("page_id", "url")


def article_restricted_sql() -> str:
    host = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
    out = " OR ".join(f"h = '{x.lower()}' OR ends_with(h, '.{x.lower()}')" for x in EXCLUDED)
    return f"SELECT page_id, url FROM (SELECT page_id, url, regexp_replace(regexp_replace({host}, '^.*@|:[0-9]*$', '', 'g'), '\\.$', '') AS h FROM pages) WHERE h IS NULL OR NOT ({out})"


def write_payloads(spark, sf_dir) -> tuple[str, str]:
    """Payload files ``[meta, rows]``: observations a nation and indicator, with a
    row without a value in each, and the countries, those of one region without coordinates."""
    base = scratch_path(spark, f"payloads/{uuid.uuid4().hex}")
    pair = lambda a, b: F.struct(a.alias("id"), b.alias("value"))
    x = DQ.indicator_long(spark, sf_dir)
    x = x.unionByName(x.select(*[c for c in x.columns if c not in ("year", "value")]).distinct().withColumns({"year": F.lit(1900), "value": F.lit(None).cast("double")}))
    one = F.struct(pair(F.col("indicator_code"), F.col("indicator_name")).alias("indicator"), pair(F.substring("countryiso3code", 1, 2), F.col("country_name")).alias("country"),
                   "countryiso3code", F.col("year").cast("string").alias("date"), F.col("value").cast("string").alias("value"))
    text = lambda rows: F.concat(F.lit('[{"page": 1},'), F.to_json(F.collect_list(rows)), F.lit("]"))
    pages = x.groupBy("indicator_code", "countryiso3code").agg(text(one).alias("value"))
    (pages.withColumn("page", F.concat_ws("-", F.col("indicator_code"), F.col("countryiso3code"))).drop("indicator_code", "countryiso3code")
     .repartition("page").write.partitionBy("page").text(f"{base}/observations"))
    na = S.table(spark, sf_dir, "nation")
    there = F.when(F.col("n_regionkey") == 4, " ").otherwise(F.col("n_nationkey").cast("string"))
    country = F.struct(_code("n_nationkey").alias("id"), F.col("n_name").alias("name"), there.alias("longitude"), there.alias("latitude"),
                       pair(F.lit("X"), F.lit("mixed")).alias("incomeLevel"), pair(F.col("n_regionkey").cast("string"), F.col("n_regionkey").cast("string")).alias("region"))
    na.agg(text(country).alias("value")).write.text(f"{base}/countries")
    return f"{base}/observations", f"{base}/countries"


def indicator_files(spark, sf_dir) -> DataFrame:
    """P11-P15 and A8 over payload files: the wide table of the real countries."""
    observations, countries = write_payloads(spark, sf_dir)
    long = I.flatten_observations(readers.read_payload_rows(spark, observations), start_year=DQ.IND_START, end_year=DQ.IND_END)
    real = I.real_countries(I.country_metadata(readers.read_payload_rows(spark, countries, readers.COUNTRY)))
    long = long.join(real.select(F.col("id").alias("countryiso3code")), "countryiso3code", "left_semi")
    return I.wide_table(long, DQ.INDICATORS, list(range(DQ.IND_START, DQ.IND_END + 1)))


def indicator_files_sql() -> str:
    return f"SELECT w.* FROM ({DS.indicator_wide()}) w JOIN nation n ON n.n_name = w.country_name WHERE n.n_regionkey <> 4"


QUERIES = {"indicator_files": indicator_files, "event_files": event_files, "model_table_from_files": model_table_from_files, "date_spellings": date_spellings, "article_restricted": article_restricted}
SQL = {"indicator_files": indicator_files_sql, "event_files": event_files_sql, "model_table_from_files": model_table_from_files_sql, "date_spellings": date_spellings_sql, "article_restricted": article_restricted_sql}
