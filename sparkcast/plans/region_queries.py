"""Registered region-matching queries.

Stand-ins: the boundary attribute table is ``part`` (country = brand,
English name = part name, local name = type + name, alternatives = the two
name words swapped and the type, load order = part key). Event names come
from every ``lineitem`` row joined to its part: the line number picks one
spelling -- exact, local, alternative, accented upper case, truncated,
second word + ' zone', or type + ' province' -- so all tiers are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import normalize
from ..operators import regions as R
from ..session import materialize, spread
from . import standins as S


def part_boundaries(spark, sf_dir) -> DataFrame:
    p = S.table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    return p.select(F.col("p_brand").alias("adm0_a3"), F.col("p_name").alias("name_en"),
                    F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("name"),
                    F.concat(F.try_element_at(w, F.lit(2)), F.lit(" "), F.try_element_at(w, F.lit(1)), F.lit("|"),
                             F.col("p_type")).alias("name_alt"),
                    F.col("p_partkey").alias("pos"))


def raw_event_names(spark, sf_dir) -> DataFrame:
    # the spelling depends only on (part, line number): collapse the lines to
    # those pairs before the join (partial aggregation on two integers)
    li = S.table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber").distinct()
    p = S.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    w = F.split("p_name", " ")
    n = F.col("l_linenumber")
    admin1 = (F.when(n == 1, F.col("p_name"))
              .when(n == 2, F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")))
              .when(n == 3, F.concat(F.try_element_at(w, F.lit(2)), F.lit(" "), F.try_element_at(w, F.lit(1))))
              .when(n == 4, F.expr("substring(p_name, 1, length(p_name) - 1)"))
              .when(n == 5, F.concat(F.try_element_at(w, F.lit(2)), F.lit(" zone")))
              .when(n == 6, F.translate(F.upper("p_name"), "AEIO", "ÁÉÍÖ"))
              .otherwise(F.concat(F.col("p_type"), F.lit(" province"))))
    return (li.join(p, li.l_partkey == p.p_partkey)
            .select(F.col("p_brand").alias("country"), admin1.alias("admin1")))


def match_keys(spark, sf_dir) -> DataFrame:
    """Distinct (country, normalised name): F1 runs once per distinct name."""
    d = raw_event_names(spark, sf_dir).distinct()
    return d.select("country", normalize("admin1").alias("key")).distinct()


def _live(keys):
    return keys.where(F.col("key").isNotNull() & (F.col("key") != ""))


def region_match_exact(spark, sf_dir):
    entries = R.candidate_entries(part_boundaries(spark, sf_dir))
    return R.exact_matches(_live(match_keys(spark, sf_dir)), R.exact_maps(entries))


def _after_exact(spark, sf_dir):
    entries = materialize(R.candidate_entries(part_boundaries(spark, sf_dir)))
    live = materialize(_live(match_keys(spark, sf_dir)))
    t13 = R.exact_matches(live, R.exact_maps(entries))
    rest = live.join(t13.select("country", "key"), ["country", "key"], "left_anti")
    return rest, materialize(R.candidate_pool(entries))


def region_match_fuzzy(spark, sf_dir):
    rest, pool = _after_exact(spark, sf_dir)
    return R.fuzzy_matches(rest, pool)


def region_match_overlap(spark, sf_dir):
    rest, pool = _after_exact(spark, sf_dir)
    t4 = R.fuzzy_matches(rest, pool)
    rest2 = rest.join(t4.select("country", "key"), ["country", "key"], "left_anti")
    return R.overlap_matches(rest2, pool)


def region_match_cascade(spark, sf_dir):
    return R.match_regions(match_keys(spark, sf_dir), part_boundaries(spark, sf_dir))


def normalize_names(spark, sf_dir):
    d = spread(S.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", normalize("text").alias("name_norm"))


def country_code_overrides(spark, sf_dir):
    """Customers as events: id = first three letters of the market segment +
    customer key, country = nation name, admin1 = market segment. Override
    table: nations of AFRICA and ASIA get their region's first three
    letters as code (a bounded look-up derived from nation x region)."""
    cu = S.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    na = S.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rg = S.table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    ev = (cu.join(F.broadcast(na), cu.c_nationkey == na.n_nationkey)
          .select("c_custkey",
                  F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), F.col("c_custkey").cast("string"))
                  .alias("event_id_cnty"),
                  F.col("n_name").alias("country"), F.col("c_mktsegment").alias("admin1")))
    ov = (na.join(rg, na.n_regionkey == rg.r_regionkey)
          .where(F.col("r_name").isin("AFRICA", "ASIA"))
          .select(F.col("n_name").alias("country"), F.upper(F.substring("r_name", 1, 3)).alias("code")))
    out = R.prepare_event_keys(ev, overrides=ov)
    return out.select("c_custkey", "country_code", "admin1_norm")


QUERIES = {
    "normalize_names": normalize_names,
    "country_code_overrides": country_code_overrides,
    "region_match_exact": region_match_exact,
    "region_match_fuzzy": region_match_fuzzy,
    "region_match_overlap": region_match_overlap,
    "region_match_cascade": region_match_cascade,
}
