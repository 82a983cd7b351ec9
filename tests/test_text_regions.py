"""Goldens G5-G7 and the region-matching cascade."""

import random

from pyspark.sql import functions as F

from sparkcast.functions import text as T
from sparkcast.operators import regions as R


def test_g5_normalize(spark):
    df = spark.createDataFrame([(1, None), (2, "  Ardèche  "), (3, "Côte-d’Or"), (4, "Łódź"), (5, "a  b\tc")],
                               "i int, s string")
    got = {r.i: r.n for r in df.select("i", T.normalize("s").alias("n")).collect()}
    assert got == {1: "", 2: "Ardeche", 3: "Cote-Dor", 4: "Odz", 5: "A B C"}
    p = {r.i: r.n for r in df.select("i", T.normalize("s", True).alias("n")).collect()}
    assert p[3] == "Cotedor"


def test_g7_ratio(spark):
    df = spark.createDataFrame([("kitten", "sitting", 62), ("southern", "northern", 75), ("abc", "xyz", 0),
                                ("a", "a", 100), ("", "", 100), ("", "a", 0)], "a string, b string, want int")
    for r in df.select("want", T.fuzzy_ratio(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == r.want


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(cur[j - 1], prev[j]))
        prev = cur
    return prev[-1]


def test_lcs_bits_matches_dp(spark):
    rnd = random.Random(7)
    pairs = [("".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 30))),
              "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 62)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.select("a", "b", T.lcs_bits(F.col("a"), T.char_masks(F.col("b")), F.length("b")).alias("bits"),
                    T.lcs_bits_codes(T.char_codes(F.col("a")), T.ascii_mask_array(T.char_masks(F.col("b"))),
                                     F.length("b")).alias("codes"),
                    T.lcs_words(F.col("a"), F.col("b")).alias("words")).collect()
    for r in out:
        assert r.bits == r.codes == r.words == _lcs(r.a, r.b)


def test_long_names(spark):
    """Names of 63-300 characters against the plain rule."""
    rnd = random.Random(11)
    name = lambda: "".join(rnd.choice("abcde fé") for _ in range(rnd.choice([1, 30, 61, 62, 63, 123, 124, 125, 186, 300])))
    pairs = [(name(), name()) for _ in range(60)] + [("ab" * 60, "ba" * 60), ("a" * 124, "a" * 125), ("a" * 300, "b" * 300), ("", "a" * 70)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", T.lcs_words(F.col("a"), F.col("b")).alias("n"), T.fuzzy_ratio(F.col("a"), F.col("b")).alias("score")).collect():
        n = _lcs(r.a, r.b) if r.a else 0
        assert r.score == (100 if r.a == r.b else round(200.0 * n / (len(r.a) + len(r.b))))
        assert not r.a or r.n == n


def test_g6_cascade(spark):
    cands = spark.createDataFrame(
        [("FR", "rhone", "R1", 0), ("FR", "loire", "R2", 1), ("FR", "haute loire", "R3", 2),
         ("GH", "greater accra", "G1", 3), ("FR", "rhone", "R9", 4)],
        "adm0_a3 string, name_en string, rid string, pos long")
    b = cands.select("adm0_a3", "name_en", F.lit(None).cast("string").alias("name"),
                     F.lit(None).cast("string").alias("name_alt"), "pos", "rid")
    keys = spark.createDataFrame([("FR", "rhone"), ("FR", "loir"), ("GH", "accra"), ("ZZ", "x"), ("FR", "")],
                                 "country string, raw string")
    keys = keys.select("country", T.normalize("raw").alias("key"))
    got = {(r.country, r.key): (r.region_id, r.tier) for r in R.match_regions(keys, b, id_col="rid").collect()}
    assert got[("FR", "Rhone")] == ("R9", 1)
    assert got[("FR", "Loir")] == ("R2", 4)
    assert got[("GH", "Accra")] == ("G1", 5)
    assert got[("ZZ", "X")] == (None, None)
    assert got[("FR", "")] == (None, None)


def test_tiers_two_three_and_last_wins(spark):
    b = spark.createDataFrame(
        [("AA", "North", "Nord", "Septentrion|  |Boreal", 0), ("AA", "South", "Sud", "Boreal", 1)],
        "adm0_a3 string, name_en string, name string, name_alt string, pos long")
    keys = spark.createDataFrame([("AA", "Nord"), ("AA", "Septentrion"), ("AA", "Boreal")], "country string, key string")
    got = {r.key: (r.region_id, r.tier) for r in R.match_regions(keys, b).collect()}
    assert got["Nord"] == ("AA - North", 2)
    assert got["Septentrion"] == ("AA - North", 3)
    assert got["Boreal"] == ("AA - South", 3)   # duplicate alternative: last loaded wins


def test_fuzzy_tie_first_in_order(spark):
    b = spark.createDataFrame([("AA", "abcx", 0), ("AA", "abcy", 1)], "adm0_a3 string, name_en string, pos long") \
        .select("adm0_a3", "name_en", F.lit(None).cast("string").alias("name"),
                F.lit(None).cast("string").alias("name_alt"), "pos")
    keys = spark.createDataFrame([("AA", "Abcz")], "country string, key string")
    r = R.match_regions(keys, b).collect()[0]
    assert (r.region_id, r.tier) == ("AA - abcx", 4)


def test_event_overrides(spark):
    ev = spark.createDataFrame(
        [("XXX1", "Chile", "Santiago"), ("UKR2", "Ukraine", "Crimea"), ("FRA3", "Mayotte", None),
         ("USA4", "Puerto Rico", "San Juan"), ("ISR5", "Israel", "HaDarom")],
        "event_id_cnty string, country string, admin1 string")
    got = {r.event_id_cnty: (r.country_code, r.admin1_norm) for r in R.prepare_event_keys(ev).collect()}
    assert got["XXX1"] == ("CHL", "Santiago")
    assert got["UKR2"] == ("RUS", "Crimea")
    assert got["FRA3"] == ("FRA", "Mayotte")
    assert got["USA4"] == ("PRI", "Puerto Rico")
    assert got["ISR5"] == ("ISR", "Southern")


def test_length_buckets_never_split_admissible_pairs():
    """Every length pair that can still score 60 lies in the same or a
    neighbouring bucket (so the blocked join misses no candidate)."""
    import math
    base = R._BUCKET_BASE
    for a in range(1, 400):
        for b in range(a, 1000):
            if 200 * a >= 59.5 * (a + b):
                assert abs(math.floor(math.log(a) / base) - math.floor(math.log(b) / base)) <= 1


def test_normalize_holds_a_slice_of_strings():
    """Long texts aren't all held as strings at once, several times over; the result is that of each value."""
    import tracemalloc

    import pyarrow as pa

    from sparkcast.functions.text import normalize_array
    odd = [None, "", " \t", "são  tomé e príncipe", "o'brien-st. x1y", "\x1cA\x1f b", "北 京", "ﬁ Ⅳ"]
    for strip, want in ((False, ["", "", "", "Sao Tome E Principe", "O'Brien-St. X1Y", "A B", "", "Fi Iv"]),
                        (True, ["", "", "", "Sao Tome E Principe", "Obrienst X1Y", "A B", "", "Fi Iv"])):
        assert normalize_array(pa.array(odd), strip).to_pylist() == want
    col = pa.array(["word " * 1000 + str(i) for i in range(4000)])
    tracemalloc.start()
    out = normalize_array(col)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 4000 and out[7].as_py() == "Word " * 1000 + "7"
    assert peak < 6 << 20       # of 20 MB
