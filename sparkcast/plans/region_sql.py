"""DuckDB oracle SQL for the region-matching queries (brute force: every
key is scored against every name of its country, no pruning)."""

from __future__ import annotations

WS = r"[\t\n\x0b\x0c\r\x1c-\x1f ]+"


def title(expr: str) -> str:
    """Title case: each run of letters -> first upper, rest lower."""
    return (f"array_to_string(list_transform(regexp_extract_all({expr}, '[A-Za-z]+|[^A-Za-z]+'), "
            f"lambda r: CASE WHEN regexp_full_match(r, '[A-Za-z]+') THEN upper(r[1]) || lower(r[2:]) "
            f"ELSE r END), '')")


def norm(expr: str) -> str:
    """Accent fold to ASCII, collapse whitespace, trim, title case."""
    folded = (f"trim(regexp_replace(regexp_replace(strip_accents(coalesce({expr}, '')), "
              rf"'[^\x00-\x7F]', '', 'g'), '{WS}', ' ', 'g'))")
    return title(folded)


def processed(expr: str) -> str:
    return f"lower(trim(regexp_replace({expr}, '[^A-Za-z0-9_]', ' ', 'g')))"


def tokens(expr: str) -> str:
    return (f"list_distinct(list_transform(list_filter(string_split({expr}, ' '), lambda w: length(w) > 3), "
            rf"lambda w: lower(trim(regexp_replace(w, '[^A-Za-z0-9_\s]', '', 'g')))))")


def _ctes() -> str:
    return f"""
b AS (SELECT p_brand AS country, p_name AS name_en, p_type || ' ' || p_name AS name,
             string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] || '|' || p_type AS name_alt,
             CAST(p_partkey AS BIGINT) AS pos, p_brand || ' - ' || p_name AS rid FROM part),
alts AS (SELECT country, rid, pos, a.generate_subscript AS k, a.alt
         FROM b, LATERAL (SELECT generate_subscripts(xs, 1) AS generate_subscript, unnest(xs) AS alt
                          FROM (SELECT string_split(coalesce(b.name_alt, ''), '|') AS xs)) a),
ent0 AS (
  SELECT country, name_en AS raw, rid, pos, 0 AS slot, 'en' AS kind FROM b
  UNION ALL SELECT country, name, rid, pos, 1, 'name' FROM b
  UNION ALL SELECT country, alt, rid, pos, k + 1, 'alt' FROM alts WHERE trim(alt) <> ''),
ent AS (SELECT country, {norm('raw')} AS cname, rid, pos, slot, kind FROM ent0),
entries AS (SELECT * FROM ent WHERE cname <> ''),
maps AS (SELECT country, cname, tier, rid FROM (
  SELECT country, cname, CASE kind WHEN 'en' THEN 1 WHEN 'name' THEN 2 ELSE 3 END AS tier, rid,
         row_number() OVER (PARTITION BY country, cname, kind ORDER BY pos DESC, slot DESC) AS rn
  FROM entries) WHERE rn = 1),
pool0 AS (SELECT country, cname,
    first_value(rid) OVER (PARTITION BY country, cname ORDER BY pos DESC, slot DESC) AS rid,
    min(pos * 1000 + slot) OVER (PARTITION BY country, cname) AS firstpos
  FROM entries),
pool AS (SELECT DISTINCT country, cname, rid, firstpos, {processed('cname')} AS pc FROM pool0),
poolm AS (SELECT *, length(pc) AS plen, (CAST(1 AS BIGINT) << length(pc)) - 1 AS fm,
    map_from_entries(list_transform(list_distinct(string_split(pc, '')), lambda ch: struct_pack(k := ch,
      v := list_reduce(list_transform(range(1, length(pc) + 1), lambda j: CASE WHEN substr(pc, j, 1) = ch
           THEN CAST(1 AS BIGINT) << (j - 1) ELSE CAST(0 AS BIGINT) END), lambda x, y: x | y, CAST(0 AS BIGINT))))) AS masks,
    {tokens('cname')} AS ptok
  FROM pool),
li AS (SELECT p.p_brand AS country,
    CASE l.l_linenumber
      WHEN 1 THEN p.p_name
      WHEN 2 THEN p.p_type || ' ' || p.p_name
      WHEN 3 THEN string_split(p.p_name, ' ')[2] || ' ' || string_split(p.p_name, ' ')[1]
      WHEN 4 THEN substr(p.p_name, 1, length(p.p_name) - 1)
      WHEN 5 THEN string_split(p.p_name, ' ')[2] || ' zone'
      WHEN 6 THEN translate(upper(p.p_name), 'AEIO', 'ÁÉÍÖ')
      ELSE p.p_type || ' province' END AS admin1
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
keys AS (SELECT DISTINCT country, {norm('admin1')} AS key FROM (SELECT DISTINCT country, admin1 FROM li)),
live AS (SELECT * FROM keys WHERE key IS NOT NULL AND key <> ''),
t13 AS (SELECT country, key, rid AS region_id, tier FROM (
  SELECT l.country, l.key, m.rid, m.tier,
         row_number() OVER (PARTITION BY l.country, l.key ORDER BY m.tier) AS rn
  FROM live l JOIN maps m ON l.country = m.country AND l.key = m.cname) WHERE rn = 1),
rest AS (SELECT * FROM live l WHERE NOT EXISTS (SELECT 1 FROM t13 t WHERE t.country = l.country AND t.key = l.key)),
kp AS (SELECT country, key, {processed('key')} AS kc FROM rest),
pairs AS (SELECT k.country, k.key, p.rid, p.firstpos,
    CASE WHEN k.kc = p.pc THEN 100
         WHEN length(k.kc) = 0 OR p.plen = 0 THEN 0
         ELSE CAST(round_even(100.0 * (2 * (p.plen - bit_count(list_reduce(string_split(k.kc, ''),
              lambda v, ch: ((v + (v & coalesce(p.masks[ch], 0))) | (v & ~coalesce(p.masks[ch], 0))) & p.fm,
              p.fm)))) / (length(k.kc) + p.plen), 0) AS INTEGER) END AS score
  FROM kp k JOIN poolm p ON k.country = p.country),
best AS (SELECT country, key, rid, score FROM (
  SELECT *, row_number() OVER (PARTITION BY country, key ORDER BY score DESC, firstpos) AS rn FROM pairs)
  WHERE rn = 1),
t4 AS (SELECT country, key, rid AS region_id, score FROM best WHERE score >= 60),
rest2 AS (SELECT * FROM rest r WHERE NOT EXISTS (SELECT 1 FROM t4 t WHERE t.country = r.country AND t.key = r.key)),
kt AS (SELECT country, key, unnest({tokens('key')}) AS tok FROM rest2),
ptk AS (SELECT country, rid, firstpos, unnest(ptok) AS tok FROM poolm),
t5 AS (SELECT country, key, region_id FROM (
  SELECT kt.country, kt.key, ptk.rid AS region_id,
         row_number() OVER (PARTITION BY kt.country, kt.key ORDER BY ptk.firstpos) AS rn
  FROM kt JOIN ptk ON kt.country = ptk.country AND kt.tok = ptk.tok) WHERE rn = 1)"""


def region_match_exact() -> str:
    return f"WITH {_ctes()}\nSELECT country, key, region_id, tier FROM t13"


def region_match_fuzzy() -> str:
    return f"WITH {_ctes()}\nSELECT country, key, region_id, score FROM t4"


def region_match_overlap() -> str:
    return f"WITH {_ctes()}\nSELECT country, key, region_id FROM t5"


def region_match_cascade() -> str:
    return f"""WITH {_ctes()},
hits AS (SELECT country, key, region_id, tier FROM t13
         UNION ALL SELECT country, key, region_id, 4 FROM t4
         UNION ALL SELECT country, key, region_id, 5 FROM t5)
SELECT k.country, k.key, h.region_id, h.tier FROM keys k LEFT JOIN hits h USING (country, key)"""


def normalize_names() -> str:
    return f"SELECT doc_id, {norm('text')} AS name_norm FROM documents"


def country_code_overrides() -> str:
    from ..operators.fixed_values import ADMIN_NAME_FIXES as fixes
    fx = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixes.items())
    return f"""WITH ev AS (
  SELECT c.c_custkey, upper(substr(c.c_mktsegment, 1, 3)) || CAST(c.c_custkey AS VARCHAR) AS event_id_cnty,
         n.n_name AS country, c.c_mktsegment AS admin1
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
ov AS (SELECT n.n_name AS country, upper(substr(r.r_name, 1, 3)) AS code
       FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name IN ('AFRICA', 'ASIA')),
c1 AS (SELECT ev.*, CASE WHEN admin1 = 'Crimea' THEN 'RUS' ELSE coalesce(ov.code, substr(event_id_cnty, 1, 3)) END AS country_code
       FROM ev LEFT JOIN ov USING (country)),
c2 AS (SELECT c_custkey, country_code,
         CASE WHEN country_code = 'PRI' THEN 'Puerto Rico' WHEN country = 'Guam' THEN 'Guam'
              WHEN country = 'Martinique' THEN 'Martinique' WHEN country = 'Mayotte' THEN 'Mayotte'
              ELSE admin1 END AS admin1 FROM c1),
c3 AS (SELECT c_custkey, country_code, {norm('admin1')} AS an FROM c2)
SELECT c_custkey, country_code, CASE an {fx} ELSE an END AS admin1_norm FROM c3"""


SQL = {
    "normalize_names": normalize_names,
    "country_code_overrides": country_code_overrides,
    "region_match_exact": region_match_exact,
    "region_match_fuzzy": region_match_fuzzy,
    "region_match_overlap": region_match_overlap,
    "region_match_cascade": region_match_cascade,
}
