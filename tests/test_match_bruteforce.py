"""The matching cascade against a direct Python rendering of its rules on
random inputs (duplicates, ties, overlaps forced by a small vocabulary)."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from sparkcast.functions.text import normalize_series
from sparkcast.operators import regions as R

WORDS = ["north", "south", "east", "west", "river", "lake", "hill", "port", "saint", "mount", "oro", "val"]


def norm(x):
    return normalize_series(pd.Series([x]))[0]


def norm_p(x):
    return normalize_series(pd.Series([x]), True)[0]


def prep(s):
    return re.sub(r"[^A-Za-z0-9_]", " ", s).lower().strip()


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(cur[j - 1], prev[j]))
        prev = cur
    return prev[-1]


def ratio(a, b):
    if a == b:
        return 100
    if not a or not b:
        return 0
    return int(round(100 * (2 * lcs(a, b) / (len(a) + len(b)))))


def words(n):
    return {norm_p(w) for w in n.split() if len(w) > 3}


def brute(cands, keys):
    en, nm, alt, pool = {}, {}, {}, {}
    for c, e, n, a, rid in cands:
        en[(c, norm(e))] = rid
        nm[(c, norm(n))] = rid
        p = pool.setdefault(c, {})
        for x in [norm(e), norm(n)] + [norm(y) for y in (a or "").split("|") if y.strip()]:
            if x:
                p[x] = rid
        for y in [norm(y) for y in (a or "").split("|") if y.strip()]:
            alt.setdefault(c, {})[y] = rid
    out = {}
    for c, k in keys:
        if not k:
            out[(c, k)] = None
        elif (c, k) in en:
            out[(c, k)] = (en[(c, k)], 1)
        elif (c, k) in nm:
            out[(c, k)] = (nm[(c, k)], 2)
        elif k in alt.get(c, {}):
            out[(c, k)] = (alt[c][k], 3)
        else:
            choices = pool.get(c, {})
            best, bs = None, -1
            for name in choices:
                s = ratio(prep(k), prep(name))
                if s > bs:
                    best, bs = name, s
            if best is not None and bs >= 60:
                out[(c, k)] = (choices[best], 4)
                continue
            kw = words(k)
            hit = None
            for name, rid in choices.items():
                if kw & words(name):
                    hit = rid
                    break
            out[(c, k)] = (hit, 5) if hit else None
    return out


import pytest


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_cascade_matches_rules(spark, seed):
    rnd = random.Random(seed)
    cands, keys = [], []
    for ci in range(6):
        c = f"C{ci}"
        for ri in range(rnd.randint(3, 9)):
            e = " ".join(rnd.sample(WORDS, rnd.randint(1, 2)))
            n = " ".join(rnd.sample(WORDS, rnd.randint(1, 2))) if rnd.random() < 0.7 else None
            a = "|".join(" ".join(rnd.sample(WORDS, 1)) for _ in range(rnd.randint(0, 2))) or None
            cands.append((c, e, n, a, f"{c}-r{ri}"))
        for _ in range(25):
            w = " ".join(rnd.sample(WORDS, rnd.randint(1, 3)))
            if rnd.random() < 0.4:
                w = w[: max(1, len(w) - rnd.randint(1, 3))]
            keys.append((c, norm(w)))
    keys = list(dict.fromkeys(keys))
    want = brute(cands, keys)
    b = spark.createDataFrame([(c, e, n, a, rid, i) for i, (c, e, n, a, rid) in enumerate(cands)],
                              "adm0_a3 string, name_en string, name string, name_alt string, rid string, pos long")
    kd = spark.createDataFrame(keys, "country string, key string")
    got = {(r.country, r.key): ((r.region_id, r.tier) if r.region_id is not None else None)
           for r in R.match_regions(kd, b, id_col="rid").collect()}
    assert got == want
    tiers = {v[1] for v in want.values() if v}
    print("tiers", sorted(tiers), "unmatched", sum(v is None for v in want.values()))
    assert {1, 4}.issubset(tiers)   # the random data reaches the exact and fuzzy tiers


def test_fuzzy_general_path_scores(spark):
    """Non-ASCII strings and candidates longer than 62 characters take the
    map / DP path inside fuzzy_matches; every score equals the rule."""
    rnd = random.Random(5)
    alphabet = "abcdeé ñ"
    keys = [("C", "".join(rnd.choice(alphabet) for _ in range(rnd.randint(3, 12)))) for _ in range(15)]
    names = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(3, 12))) for _ in range(10)]
    names += ["ab" * 35, "a" * 64 + "bc"]          # longer than 62 characters
    b = spark.createDataFrame([("C", n, None, None, i) for i, n in enumerate(names)],
                              "adm0_a3 string, name_en string, name string, name_alt string, pos long")
    pool = R.candidate_pool(R.candidate_entries(b))
    kd = spark.createDataFrame(keys, "country string, key string").distinct()
    got = {(r.key, r.rid): r.score for r in R.fuzzy_matches(kd, pool, all_scores=True).collect()}
    pool_rows = {r.rid: r.cname for r in pool.collect()}
    for (k, rid), s in got.items():
        assert s == ratio(prep_u(k), prep_u(pool_rows[rid])), (k, pool_rows[rid])
    assert any(len(n) > 62 for n in pool_rows.values())


def prep_u(s):
    # the Spark preparation keeps only [A-Za-z0-9_] as letters
    return re.sub(r"[^A-Za-z0-9_]", " ", s).lower().strip()
