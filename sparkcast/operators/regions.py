"""Free-text region names -> reference region ids (F1, F12, F13, F19,
J1-J7, J14, W6, P6-P10, O3, O4).

Match rules, first hit wins (J6):

1. exact normalised English name in the same country,
2. exact normalised local name,
3. exact normalised alternative name,
4. best fuzzy ratio over every name of the country, accepted at >= 60
   (ties: first name in load order),
5. first name (load order) sharing a word longer than 3 characters;

else null; an empty name never matches. When one name maps to several
regions the last loaded wins (W6); the position of a name in the country's
candidate order is where it was first seen.

Scale: the event side is reduced to distinct (country, name) keys before any
matching and joined back at the end (J7). The candidate side is the boundary
table (thousands of rows). Tier 4 only scores keys left over by tiers 1-3,
within a country and a length band outside of which a score of 60 is
impossible (exact pruning, no cap). Tier 5 pre-aggregates candidates per
(country, word) so a common word never fans out into all pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.text import (MAX_BITS, ascii_mask_array, char_codes, char_masks, fuzzy_ratio,
                              lcs_bits_codes, normalize, ratio_process, word_tokens)
from ..session import materialize
from . import fixed_values as FV

TIER_EN, TIER_NAME, TIER_ALT, TIER_FUZZY, TIER_WORDS = 1, 2, 3, 4, 5


def region_id(country: str = "adm0_a3", name_en: str = "name_en"):
    """``"{country} - {name_en}"`` (null in -> null out)."""
    return F.concat(F.col(country), F.lit(" - "), F.col(name_en))


def candidate_entries(boundaries: DataFrame, country: str = "adm0_a3", name_en: str = "name_en",
                      name: str = "name", name_alt: str = "name_alt", pos: str = "pos",
                      id_col: str | None = None) -> DataFrame:
    """One row per (region, name slot): ``country, cname, region_id, pos,
    slot, kind``. Slot 0 = English name, 1 = local name, 2.. = alternatives
    (P10: split on '|', blanks dropped). Blank normalised names are dropped
    (Q7). ``id_col`` names an existing id column instead of P9's id."""
    rid = F.col(id_col) if id_col else region_id(country, name_en)
    b = boundaries.select(F.col(country).alias("country"), F.col(name_en).alias("_en"),
                          F.col(name).alias("_nm"), F.col(name_alt).alias("_alt"),
                          F.col(pos).cast("long").alias("pos"), rid.alias("region_id"))
    en = b.select("country", F.col("_en").alias("raw"), "region_id", "pos",
                  F.lit(0).alias("slot"), F.lit("en").alias("kind"))
    nm = b.select("country", F.col("_nm").alias("raw"), "region_id", "pos",
                  F.lit(1).alias("slot"), F.lit("name").alias("kind"))
    alts = (b.select("country", "region_id", "pos", F.posexplode(
        F.filter(F.split(F.coalesce(F.col("_alt"), F.lit("")), r"\|"), lambda x: F.trim(x) != ""))
        .alias("k", "raw"))
        .select("country", "raw", "region_id", "pos", (F.col("k") + 2).alias("slot"),
                F.lit("alt").alias("kind")))
    e = en.unionByName(nm).unionByName(alts)
    return (e.withColumn("cname", normalize("raw")).where(F.col("cname") != "")
            .select("country", "cname", "region_id", "pos", "slot", "kind"))


def exact_maps(entries: DataFrame) -> DataFrame:
    """J1-J3 look-ups with W6 (last loaded wins): ``country, cname, tier, rid``."""
    tier = F.when(F.col("kind") == "en", TIER_EN).when(F.col("kind") == "name", TIER_NAME).otherwise(TIER_ALT)
    return (entries.withColumn("tier", tier)
            .groupBy("country", "cname", "tier")
            .agg(F.max_by("region_id", F.struct("pos", "slot")).alias("rid")))


def candidate_pool(entries: DataFrame) -> DataFrame:
    """Tier 4/5 pool per country: each distinct name once, ordered by first
    sight, mapped to its last-loaded region, with the fuzzy preparation."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = (entries.groupBy("country", "cname")
         .agg(F.min(F.struct("pos", "slot")).alias("first"),
              F.max_by("region_id", F.struct("pos", "slot")).alias("rid")))
    pp = ratio_process("cname")
    # prepare the string first; the repartition keeps it a plain column for the
    # CPU-bound mask build below and spreads that build over all tasks
    q = (p.select("country", "cname", "first", "rid", pp.alias("pc"), F.length(pp).alias("plen"))
         .repartition(n)
         .select("*", char_masks(F.col("pc")).alias("pmasks"), word_tokens("cname").alias("ptokens"),
                 (F.coalesce(F.array_max(char_codes(F.col("pc"))), F.lit(0)) <= 127).alias("pascii")))
    return q.select("*", ascii_mask_array(F.col("pmasks")).alias("pmask_arr"))


def exact_matches(keys: DataFrame, maps: DataFrame) -> DataFrame:
    """Best exact tier per key: ``country, key, region_id, tier``."""
    m = keys.join(maps, (keys.country == maps.country) & (keys.key == maps.cname)) \
        .select(keys.country, keys.key, maps.tier, maps.rid)
    return (m.groupBy("country", "key")
            .agg(F.min_by("rid", "tier").alias("region_id"), F.min("tier").alias("tier")))


# A pair can only reach a rounded score of 60 when the shorter processed
# string has at least 59.5 / 140.5 of the longer one's length.
# Buckets are log-length bands a hair wider than that ratio, so two lengths
# at exactly the limit (e.g. 119 and 281) are never pushed two buckets apart
# by rounding; pairs from neighbouring buckets are then filtered exactly.
_MIN_LEN_RATIO = 59.5 / 140.5
_BUCKET_BASE = math.log(1.0 / _MIN_LEN_RATIO) * (1 + 1e-9)


def _len_bucket(length):
    return F.when(length == 0, F.lit(-10)).otherwise(F.floor(F.log(length.cast("double")) / _BUCKET_BASE))


def fuzzy_matches(keys: DataFrame, pool: DataFrame, threshold: int = FV.FUZZY_THRESHOLD,
                  all_scores: bool = False) -> DataFrame:
    """Per key the best ratio over the country's pool (ties: first in
    pool order), kept when >= ``threshold``: ``country, key, region_id, score``.

    Candidate pairs are generated per (country, length bucket) with the
    key's neighbouring buckets: lengths differing by more than the factor
    above cannot score 60, so nothing that could be accepted is left out.
    """
    kp = ratio_process("key")
    # Scoring is CPU-bound while its inputs are small in bytes, so AQE would
    # coalesce it into very few tasks: both sides are spread explicitly over
    # the configured shuffle partitions.
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = (keys.select("country", "key", kp.alias("kc"), F.length(kp).alias("klen")).repartition(n)
         .withColumn("kcodes", char_codes(F.col("kc")))
         .withColumn("kascii", F.coalesce(F.array_max("kcodes"), F.lit(0)) <= 127))
    k = k.select("*", F.explode(F.array(*[_len_bucket(F.col("klen")) + d for d in (-1, 0, 1)])).alias("b"))
    # whichever side AQE broadcasts, the other one (streamed) is spread out
    p = pool.repartition(n).select("*", _len_bucket(F.col("plen")).alias("b"))
    pairs = (k.join(p, ["country", "b"])
             .where((F.col("kc") == F.col("pc")) |
                    (F.lit(200.0) * F.least("klen", "plen") >= F.lit(59.5) * (F.col("klen") + F.col("plen")))))
    # ASCII pairs (all of them after normalisation): codes + mask array;
    # anything else takes the general form (map masks / DP)
    fast = F.col("kascii") & F.col("pascii") & (F.col("plen") <= MAX_BITS)
    lcs = lcs_bits_codes(F.col("kcodes"), F.col("pmask_arr"), F.col("plen"))
    raw = F.lit(100.0) * ((F.lit(2) * lcs).cast("double") / (F.col("klen") + F.col("plen")).cast("double"))
    fast_score = (F.when(F.col("kc") == F.col("pc"), F.lit(100))
                  .when((F.col("klen") == 0) | (F.col("plen") == 0), F.lit(0))
                  .otherwise(F.bround(raw, 0).cast("int")))
    score = F.when(fast, fast_score).otherwise(fuzzy_ratio(F.col("kc"), F.col("pc"), F.col("pmasks")))
    scored = pairs.select("country", "key", "rid", "first", score.alias("score"))
    if all_scores:
        return scored
    best = (scored.groupBy("country", "key")
            .agg(F.min_by(F.struct("rid", "score"), F.struct((-F.col("score")).alias("s"), "first")).alias("b")))
    return (best.where(F.col("b.score") >= threshold)
            .select("country", "key", F.col("b.rid").alias("region_id"), F.col("b.score").alias("score")))


def overlap_matches(keys: DataFrame, pool: DataFrame) -> DataFrame:
    """The first pool name (load order) sharing a word with the key:
    ``country, key, region_id``. The pool is first reduced to one row per
    (country, word) -- the earliest name carrying it."""
    pt = (pool.select("country", "first", "rid", F.explode("ptokens").alias("tok"))
          .groupBy("country", "tok").agg(F.min_by("rid", "first").alias("rid"), F.min("first").alias("first")))
    kt = keys.select("country", "key", F.explode(word_tokens("key")).alias("tok"))
    return (kt.join(pt, ["country", "tok"])
            .groupBy("country", "key").agg(F.min_by("rid", "first").alias("region_id")))


def match_regions(keys: DataFrame, boundaries: DataFrame, threshold: int = FV.FUZZY_THRESHOLD,
                  **cols) -> DataFrame:
    """J6 cascade over distinct keys ``(country, key)`` (key = normalised
    name). Returns every input key with ``region_id`` and ``tier`` (both null
    when nothing matches or the key is empty)."""
    keys = materialize(keys.select("country", "key").distinct())
    entries = materialize(candidate_entries(boundaries, **cols))
    live = keys.where(F.col("key").isNotNull() & (F.col("key") != "") & F.col("country").isNotNull())
    t13 = exact_matches(live, exact_maps(entries))
    rest = live.join(t13.select("country", "key"), ["country", "key"], "left_anti")
    pool = materialize(candidate_pool(entries))
    t4 = fuzzy_matches(rest, pool, threshold).select("country", "key", "region_id",
                                                    F.lit(TIER_FUZZY).alias("tier"))
    rest2 = rest.join(t4.select("country", "key"), ["country", "key"], "left_anti")
    t5 = overlap_matches(rest2, pool).select("country", "key", "region_id", F.lit(TIER_WORDS).alias("tier"))
    hits = t13.unionByName(t4).unionByName(t5)
    return keys.join(hits, ["country", "key"], "left")


def _fixes_df(spark, mapping: dict[str, str], k: str, v: str) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), f"{k} string, {v} string")


def prepare_event_keys(events: DataFrame, id_col: str = "event_id_cnty", country_col: str = "country",
                       admin_col: str = "admin1", overrides: DataFrame | None = None,
                       name_fixes: DataFrame | None = None) -> DataFrame:
    """P6-P8 + F1/F2: adds ``country_code`` and ``admin1_norm`` to events.

    ``overrides`` (country, code) defaults to the fixed country-code list and
    ``name_fixes`` (name, fixed) to the fixed rename list; both are bounded
    look-up tables joined by broadcast. The name normalisation runs once per
    distinct admin name, then joins back.
    """
    spark = events.sparkSession
    ov = overrides if overrides is not None else _fixes_df(spark, FV.COUNTRY_CODE_FIXES, "country", "code")
    ov = ov.select(F.col(ov.columns[0]).alias("_ovc"), F.col(ov.columns[1]).alias("_ovcode"))
    nf = name_fixes if name_fixes is not None else _fixes_df(spark, FV.ADMIN_NAME_FIXES, "name", "fixed")
    nf = nf.select(F.col(nf.columns[0]).alias("_nfn"), F.col(nf.columns[1]).alias("_nff"))
    e = events.join(F.broadcast(ov), F.col(country_col) == F.col("_ovc"), "left")
    code = F.coalesce(F.col("_ovcode"), F.substring(F.col(id_col), 1, 3))
    code = F.when(F.col(admin_col) == FV.CRIMEA_ADMIN, F.lit(FV.CRIMEA_CODE)).otherwise(code)
    e = e.withColumn("country_code", code).drop("_ovc", "_ovcode")
    adm = F.col(admin_col)
    for cname in FV.COUNTRY_AS_ADMIN1:
        adm = F.when(F.col(country_col) == cname, F.lit(cname)).otherwise(adm)
    for ccode, aname in FV.CODE_TO_ADMIN1.items():
        adm = F.when(F.col("country_code") == ccode, F.lit(aname)).otherwise(adm)
    e = e.withColumn(admin_col, adm)
    names = e.select(F.col(admin_col).alias("_raw")).distinct()
    names = names.select("_raw", normalize("_raw").alias("_norm"))
    names = materialize(names.join(F.broadcast(nf), F.col("_norm") == F.col("_nfn"), "left")
                        .select("_raw", F.coalesce("_nff", "_norm").alias("admin1_norm")))
    # distinct names are few next to the events; as a written table Spark knows
    # their size and broadcasts them if it allows, so that events stay in place
    return (e.join(names, e[admin_col].eqNullSafe(names["_raw"]), "left").drop("_raw"))


def attach_regions(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Each event gets its key's ``matched_admin1_id`` (null if none)."""
    m = materialize(matches.select(
        F.col("country").alias("_mc"), F.col("key").alias("_mk"), F.col("region_id").alias("matched_admin1_id")))
    return (events.join(m, (F.col("country_code") == F.col("_mc")) & (F.col("admin1_norm") == F.col("_mk")), "left")
            .drop("_mc", "_mk"))
