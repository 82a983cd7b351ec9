"""Search grid and article hits.

Hits are landed news records, one row per (query, hit). The reference walks
queries in order and keeps the first hit of every URL not yet visited; here
that is a grouped ``min`` over the (query order, hit order) struct per URL
-- map-side partial aggregation keeps a hot URL to one row per task before
the shuffle. Top-k per query is a ``row_number`` filter, which Spark turns
into a partial per-group limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import fill_placeholders
from ..session import materialize


def search_grid(templates: DataFrame, countries: DataFrame, metrics: DataFrame, years: DataFrame) -> DataFrame:
    """J15 ``generate_search_queries``: every template x country x metric x
    year with ``[country]``, ``[metric]``, ``[year]`` filled (F3), numbered
    ``query_seq`` in template > country > metric > year order.

    Inputs: ``templates(t_ord, template)``, ``countries(c_ord, country,
    code)``, ``metrics(m_ord, metric)``, ``years(y_ord, year)``, distinct.
    The query numbers are a distributed range; each number's place on every
    axis follows by arithmetic and is looked up by an equi-join with the
    numbered axis (a written table, so Spark broadcasts it only if its size
    allows): the grid is made in as many tasks as its size needs.
    """
    spark = templates.sparkSession
    axes = {"t": templates.select(F.col("t_ord").alias("_o"), F.col("template").alias("t_v")),
            "c": countries.select(F.col("c_ord").alias("_o"), F.col("country").alias("c_v"), F.col("code").alias("c_code")),
            "m": metrics.select(F.col("m_ord").alias("_o"), F.col("metric").alias("m_v")),
            "y": years.select(F.col("y_ord").alias("_o"), F.col("year").cast("string").alias("y_v"))}
    numbered, size = {}, {}
    for k, df in axes.items():
        values = [x for x in df.columns if x != "_o"]
        # an axis is a configuration list: numbering it needs one order over it
        rank = F.row_number().over(Window.orderBy("_o", *values)) - 1
        numbered[k] = materialize(df.distinct().select(rank.cast("long").alias(f"{k}_i"), *values))
        size[k] = numbered[k].count()
    total = 1
    for n in size.values():
        total *= n
    parts = min(max(1, total), max(spark.sparkContext.defaultParallelism, -(-total // 1_000_000)))
    g, below = spark.range(0, total, 1, parts).withColumnRenamed("id", "query_seq"), 1
    for k in ("y", "m", "c", "t"):
        g = g.withColumn(f"{k}_i", F.expr(f"query_seq div {max(1, below)} % {max(1, size[k])}"))
        below *= size[k]
    for k in ("y", "m", "c", "t"):
        g = g.join(numbered[k], f"{k}_i")
    search = fill_placeholders(F.col("t_v"), {"country": F.col("c_v"), "metric": F.col("m_v"), "year": F.col("y_v")})
    return g.select("query_seq", search.alias("search"), F.col("c_v").alias("country"), F.col("c_code").alias("country_code"),
                    F.col("m_v").alias("metric"), F.col("y_v").alias("year"))


def top_k_hits(hits: DataFrame, k: int, query: Sequence[str], hit_order: Sequence[str]) -> DataFrame:
    """At most ``k`` hits per query, in hit order (``hit_rank`` 1..k)."""
    w = Window.partitionBy(*query).orderBy(*hit_order)
    return hits.withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= k)


def unvisited(hits: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Hits whose URL is not in the visited set."""
    v = visited.select(F.col(visited.columns[0]).alias(url)).distinct()
    return hits.join(v, url, "left_anti")


def first_seen(hits: DataFrame, order: Sequence[str], url: str = "url",
               visited: DataFrame | None = None, max_results: int | None = None,
               query: Sequence[str] | None = None) -> DataFrame:
    """W4 ``get_bundle_search``: (W5 per query when ``max_results``), drop
    visited URLs (J16), then per URL the hit that comes first in ``order``.
    Returns the kept hit rows (all input columns)."""
    h = hits
    if max_results is not None:
        h = top_k_hits(h, max_results, query or order[:1], order[1:] or order).drop("hit_rank")
    if visited is not None:
        h = unvisited(h, visited, url)
    cols = [x for x in h.columns if x != url]
    best = (h.groupBy(url)
            .agg(F.min(F.struct(*[F.col(o) for o in order], *[F.col(x).alias("_" + x) for x in cols
                                                              if x not in order])).alias("b")))
    return best.select(F.col(url), *[F.col(f"b.{o}").alias(o) for o in order],
                       *[F.col(f"b._{x}").alias(x) for x in cols if x not in order])


def visited_after(visited: DataFrame, new_hits: DataFrame, url: str = "url") -> DataFrame:
    """The visited set extended with newly kept URLs."""
    return visited.select(url).unionByName(new_hits.select(url)).distinct()


def flatten_record(records: DataFrame) -> DataFrame:
    """The flat news table, publisher title only."""
    return records.select("title", "description", F.col("`published date`").alias("published date"),
                          "url", F.col("publisher.title").alias("publisher"))


def published_time(date: Column | str = "published date") -> Column:
    """Time stamp of an RFC 822 publication date (``Mon, 01 Jan 2024 10:00:00
    GMT``, weekday optional); null when it isn't one."""
    d = F.col(f"`{date}`") if isinstance(date, str) else date
    plain = F.regexp_replace(F.trim(d), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss zzz", "d MMM yyyy HH:mm:ss Z")])


def site_host(url: Column) -> Column:
    """Lower-case host of a URL without a last dot; null where it can't be parsed."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.$", "")


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def restrict(records: DataFrame, start=None, end=None, excluded_hosts: DataFrame | None = None,
             published: str = "published_ts", countries: Sequence[str] | None = None,
             languages: Sequence[str] | None = None, country: str = "country", language: str = "language") -> DataFrame:
    """Date window, countries, languages and excluded sites: a listed site
    excludes its host and all subdomains, in any spelling of case (a left anti join
    on the host and its suffixes). URLs that can't be parsed have no host and stay. Without a ``published`` column the time is parsed from
    ``published date``; rows without a time are outside any window."""
    r = records
    when = F.col(published) if published in r.columns else published_time() if "published date" in r.columns else None
    if start is not None:
        r = r.where(when >= F.lit(start))
    if end is not None:
        r = r.where(when < F.lit(end))
    if countries is not None:
        r = r.where(F.col(country).isin(list(countries)))
    if languages is not None:
        r = r.where(F.col(language).isin(list(languages)))
    if excluded_hosts is not None:
        ex = excluded_hosts.select(F.lower(F.trim(F.col(excluded_hosts.columns[0]))).alias("_site")).distinct()
        r = r.withColumn("_host", site_host(F.col("url")))
        # distinct hosts are few next to the records: their suffixes meet the list
        hosts = r.where("_host IS NOT NULL").select("_host").distinct()
        bad = materialize(hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("_site")).join(ex, "_site", "left_semi").select("_host").distinct())
        r = r.join(bad, "_host", "left_anti").drop("_host")
    return r


def tag_with_query(hits: DataFrame, grid: DataFrame, on: str = "query_seq") -> DataFrame:
    """P16 ``add_metadata``: each hit carries its query's country and search
    text (a join on the query number; the grid is bounded by the config)."""
    return hits.join(grid.select(on, "country", "search"), on, "left")


def with_text(articles: DataFrame, text: str = "full_text") -> DataFrame:
    """Keep articles whose page text was obtained."""
    return articles.where(F.col(text).isNotNull())
