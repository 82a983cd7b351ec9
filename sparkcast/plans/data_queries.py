"""Registered adjacency, indicator, search/article, page and stream queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from ..operators import adjacency as A, articles as AR, indicators as I, pages as PG
from ..session import spread
from . import standins as S

# Indicator stand-ins: per nation and year aggregates (prefix -> code); sums
# are taken in decimal so the stand-in values are exact.
INDICATORS = {"order_value": "ORD.VAL", "order_count": "ORD.CNT", "ship_discount": "SHP.DSC"}
IND_START, IND_END = 1995, 2001
SEARCH_TEMPLATES = ["[metric] in [country] in [year]"]
TOP_K = 3


# ---------------------------------------------------------------- adjacency
def region_edges(spark, sf_dir):
    return A.edges_from_rings(S.customer_boundaries(spark, sf_dir))


def dissolved_edges(spark, sf_dir):
    pm = S.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("child_id"), F.col("c_nationkey").cast("long").alias("parent_id"))
    return A.dissolve_edges(region_edges(spark, sf_dir), pm)


def region_replace(spark, sf_dir):
    """Customers' regions of EUROPE nations replaced by suppliers' regions."""
    base = S.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("country"), F.col("c_name").alias("name_en"), F.col("c_acctbal").alias("acctbal"))
    other = S.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("country"), F.col("s_name").alias("name_en"))
    na = S.table(spark, sf_dir, "nation")
    rg = S.table(spark, sf_dir, "region")
    eu = (na.join(rg, na.n_regionkey == rg.r_regionkey).where(F.col("r_name") == "EUROPE")
          .select(F.col("n_nationkey").alias("country")))
    return A.replace_regions(base, other, eu)


# --------------------------------------------------------------- indicators
def _iso(col):
    return F.concat(F.lit("N"), F.lpad(F.col(col).cast("string"), 2, "0"))


def indicator_long(spark, sf_dir) -> DataFrame:
    lo = F.lit(f"{IND_START:04d}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{IND_END + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    na = S.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = (S.table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi))
         .select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("year")))
    cu = S.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    oc = (o.join(cu, o.o_custkey == cu.c_custkey).groupBy("c_nationkey", "year")
          .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v_val"),
               F.count(F.lit(1)).cast("double").alias("v_cnt")))
    li = (S.table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= lo) & (F.col("l_shipdate") < hi))
          .select("l_suppkey", "l_discount", F.year("l_shipdate").alias("year")))
    su = S.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    ls = (li.join(su, li.l_suppkey == su.s_suppkey).groupBy("s_nationkey", "year")
          .agg(F.sum(F.col("l_discount").cast("decimal(10,2)")).cast("double").alias("v_dsc")))

    def shape(df, key, vcol, prefix):
        return (df.join(F.broadcast(na), F.col(key) == F.col("n_nationkey"))
                .select(_iso("n_nationkey").alias("countryiso3code"), F.col("n_name").alias("country_name"),
                        F.col("year").cast("int").alias("year"), F.col(vcol).alias("value"),
                        F.lit(INDICATORS[prefix]).alias("indicator_code"), F.lit(prefix).alias("indicator_name")))

    parts = [shape(oc, "c_nationkey", "v_val", "order_value"), shape(oc, "c_nationkey", "v_cnt", "order_count"),
             shape(ls, "s_nationkey", "v_dsc", "ship_discount")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value").isNotNull())


def indicator_wide(spark, sf_dir):
    return I.wide_table(indicator_long(spark, sf_dir), INDICATORS, list(range(IND_START, IND_END + 1)))


def indicator_summary(spark, sf_dir):
    s = I.summary(indicator_long(spark, sf_dir))
    return s.withColumn("latest_mean", F.round("latest_mean", 4))


# ------------------------------------------------------- searches, articles
def search_grid(spark, sf_dir):
    tpl = spark.createDataFrame([(i, t) for i, t in enumerate(SEARCH_TEMPLATES)], "t_ord int, template string")
    na = S.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_ord"), F.col("n_name").alias("country"), _iso("n_nationkey").alias("code"))
    me = (S.table(spark, sf_dir, "events").select(F.col("event_type").alias("metric")).distinct()
          .select(F.col("metric").alias("m_ord"), "metric"))
    yr = (S.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()
          .select((-F.col("y")).alias("y_ord"), F.col("y").cast("string").alias("year")))
    return AR.search_grid(tpl, na, me, yr)


def _hits(spark, sf_dir) -> DataFrame:
    """Documents as landed hits: URL = the text, query = (source, lang),
    hit order = document id."""
    return S.table(spark, sf_dir, "documents").select(
        F.col("text").alias("url"), "source", "lang", "doc_id")


def _visited(spark, sf_dir) -> DataFrame:
    d = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    lb = S.table(spark, sf_dir, "labels").select("doc_id")
    return d.join(lb, "doc_id", "left_semi").select(F.col("text").alias("url"))


def article_topk(spark, sf_dir):
    t = AR.top_k_hits(_hits(spark, sf_dir), TOP_K, ["source", "lang"], ["doc_id"])
    return t.select("source", "lang", "doc_id", "hit_rank")


def article_unvisited(spark, sf_dir):
    return AR.unvisited(_hits(spark, sf_dir), _visited(spark, sf_dir)).select("doc_id", "source", "lang")


def article_first_seen(spark, sf_dir):
    f = AR.first_seen(_hits(spark, sf_dir), ["source", "lang", "doc_id"], visited=_visited(spark, sf_dir))
    return f.select("doc_id", "source", "lang")


def url_stream_dedupe(spark, sf_dir):
    from ..streaming.dedupe import dedupe_stream
    # a file stream source takes a directory or a glob; this glob matches the
    # one table file (new files landing next to it would match a wider glob)
    src = os.path.join(sf_dir, "documents.parque[t]")
    schema = S.table(spark, sf_dir, "documents").schema
    out = dedupe_stream(spark, src, schema, url="text")
    # which copy of a repeated URL is kept is arbitrary within a batch, so the
    # result is reported by what the URL determines: its digest and length
    return spark.read.parquet(out).select(F.md5("text").alias("url_md5"), "n_chars")


def url_first_seen_stream(spark, sf_dir):
    """First seen over a stream: the first hit in query order, apart from visited ones."""
    from ..streaming.first_seen import first_seen_stream
    out = first_seen_stream(spark, os.path.join(sf_dir, "documents.parque[t]"), S.table(spark, sf_dir, "documents").schema,
                            ["source", "lang", "doc_id"], url="text", visited=_visited(spark, sf_dir))
    return spark.read.parquet(out).select("doc_id", "source", "lang")


# ----------------------------------------------------- pages, answers, matrix
def page_blocks(spark, sf_dir):
    p = spread(S.table(spark, sf_dir, "pages"))
    return p.select("page_id", PG.page_blocks("html").alias("text"))


def page_fallback(spark, sf_dir):
    p = spread(S.table(spark, sf_dir, "pages"))
    return p.select("page_id", PG.page_fallback("html").alias("f")).select("page_id", "f.source", "f.text")


def answer_rows(spark, sf_dir):
    cv = S.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return PG.answer_rows(cv, "text", keys=["conv_id", "turn"])


def occurrence_rows(spark, sf_dir) -> DataFrame:
    """Orders as reported occurrences: country = the customer's nation,
    metric = priority, one date per order written in the style its status
    picks (MM-yyyy, MMMM-yyyy or yyyy-MM)."""
    o = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    cu = S.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = S.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    fmt = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MM-yyyy"))
           .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "MMMM-yyyy"))
           .otherwise(F.date_format("o_orderdate", "yyyy-MM")))
    return (o.join(cu, o.o_custkey == cu.c_custkey).join(F.broadcast(na), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("country"), F.col("o_orderpriority").alias("metric"),
                    F.array(fmt).alias("dates")))


def metric_matrix(spark, sf_dir):
    return PG.occurrence_cells(occurrence_rows(spark, sf_dir), S.EVENT_TYPES)


QUERIES = {
    "region_edges": region_edges,
    "dissolved_edges": dissolved_edges,
    "region_replace": region_replace,
    "indicator_wide": indicator_wide,
    "indicator_summary": indicator_summary,
    "search_grid": search_grid,
    "article_first_seen": article_first_seen,
    "article_topk": article_topk,
    "article_unvisited": article_unvisited,
    "page_blocks": page_blocks,
    "page_fallback": page_fallback,
    "answer_rows": answer_rows,
    "metric_matrix": metric_matrix,
    "url_stream_dedupe": url_stream_dedupe,
    "url_first_seen_stream": url_first_seen_stream,
}
