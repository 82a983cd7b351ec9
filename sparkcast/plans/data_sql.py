"""DuckDB oracle SQL for adjacency, indicator, search/article, page queries."""

from __future__ import annotations

from . import data_queries as D
from . import standins as S

WS = r"[ \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_ws(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def region_edges() -> str:
    return """SELECT a.c_custkey AS region_id, b.c_custkey AS neighbour_id
FROM customer a JOIN customer b
  ON abs(a.c_nationkey - b.c_nationkey) <= 1 AND abs(a.c_custkey - b.c_custkey) <= 1
 AND a.c_custkey <> b.c_custkey"""


def dissolved_edges() -> str:
    return f"""WITH e AS ({region_edges()})
SELECT DISTINCT CAST(ca.c_nationkey AS BIGINT) AS region_id, CAST(cb.c_nationkey AS BIGINT) AS neighbour_id
FROM e JOIN customer ca ON e.region_id = ca.c_custkey JOIN customer cb ON e.neighbour_id = cb.c_custkey
WHERE ca.c_nationkey <> cb.c_nationkey"""


def region_replace() -> str:
    return """WITH eu AS (SELECT n.n_nationkey FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
            WHERE r.r_name = 'EUROPE')
SELECT c_nationkey AS country, c_name AS name_en, c_acctbal AS acctbal FROM customer
WHERE c_nationkey NOT IN (SELECT n_nationkey FROM eu)
UNION ALL
SELECT s_nationkey, s_name, CAST(NULL AS DOUBLE) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM eu)"""


def _long() -> str:
    lo, hi = f"TIMESTAMP '{D.IND_START:04d}-01-01'", f"TIMESTAMP '{D.IND_END + 1:04d}-01-01'"
    return f"""
oc AS (SELECT c.c_nationkey AS nk, CAST(year(o.o_orderdate) AS INTEGER) AS year,
              CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v_val, CAST(count(*) AS DOUBLE) AS v_cnt
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       WHERE o.o_orderdate >= {lo} AND o.o_orderdate < {hi} GROUP BY 1, 2),
ls AS (SELECT s.s_nationkey AS nk, CAST(year(l.l_shipdate) AS INTEGER) AS year, CAST(sum(CAST(l.l_discount AS DECIMAL(10,2))) AS DOUBLE) AS v_dsc
       FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
       WHERE l.l_shipdate >= {lo} AND l.l_shipdate < {hi} GROUP BY 1, 2),
lng AS (
  SELECT 'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') AS countryiso3code, n.n_name AS country_name,
         oc.year, oc.v_val AS value, 'ORD.VAL' AS indicator_code, 'order_value' AS indicator_name
  FROM oc JOIN nation n ON oc.nk = n.n_nationkey
  UNION ALL
  SELECT 'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0'), n.n_name, oc.year, oc.v_cnt, 'ORD.CNT', 'order_count'
  FROM oc JOIN nation n ON oc.nk = n.n_nationkey
  UNION ALL
  SELECT 'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0'), n.n_name, ls.year, ls.v_dsc, 'SHP.DSC', 'ship_discount'
  FROM ls JOIN nation n ON ls.nk = n.n_nationkey)"""


def indicator_wide() -> str:
    cols = ",\n  ".join(
        f"max(value) FILTER (WHERE indicator_code = '{code}' AND year = {y}) AS \"{prefix}_{y}\""
        for prefix, code in D.INDICATORS.items() for y in range(D.IND_START, D.IND_END + 1))
    return f"""WITH {_long()}
SELECT countryiso3code, country_name,
  {cols}
FROM lng WHERE value IS NOT NULL GROUP BY countryiso3code, country_name"""


def indicator_summary() -> str:
    return f"""WITH {_long()},
mx AS (SELECT indicator_code, max(year) AS ymax FROM lng GROUP BY 1)
SELECT l.indicator_code, count(DISTINCT countryiso3code) AS countries, min(year) AS year_min, max(year) AS year_max,
       count(*) AS records, round(avg(value) FILTER (WHERE year = mx.ymax), 4) AS latest_mean
FROM lng l JOIN mx USING (indicator_code) GROUP BY l.indicator_code"""


def search_grid() -> str:
    tpl = D.SEARCH_TEMPLATES[0].replace("'", "''")
    return f"""WITH c AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ci, n_name AS country,
                  'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation),
m AS (SELECT row_number() OVER (ORDER BY metric) - 1 AS mi, metric FROM (SELECT DISTINCT event_type AS metric FROM events)),
y AS (SELECT row_number() OVER (ORDER BY yr DESC) - 1 AS yi, CAST(yr AS VARCHAR) AS year
      FROM (SELECT DISTINCT year(o_orderdate) AS yr FROM orders)),
n AS (SELECT (SELECT count(*) FROM c) AS nc, (SELECT count(*) FROM m) AS nm, (SELECT count(*) FROM y) AS ny)
SELECT CAST((ci * nm + mi) * ny + yi AS BIGINT) AS query_seq,
       replace(replace(replace('{tpl}', '[country]', country), '[metric]', metric), '[year]', year) AS search,
       country, code AS country_code, metric, year
FROM c, m, y, n"""


def article_topk() -> str:
    return f"""SELECT source, lang, doc_id, CAST(rn AS INTEGER) AS hit_rank FROM (
  SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn <= {D.TOP_K}"""


def _visited() -> str:
    return "SELECT d.text FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)"


def article_unvisited() -> str:
    return f"SELECT doc_id, source, lang FROM documents WHERE text NOT IN ({_visited()})"


def article_first_seen() -> str:
    return f"""SELECT doc_id, source, lang FROM (
  SELECT doc_id, source, lang, row_number() OVER (PARTITION BY text ORDER BY source, lang, doc_id) AS rn
  FROM documents WHERE text NOT IN ({_visited()})) WHERE rn = 1"""


def _html_text(e: str) -> str:
    t = f"regexp_replace({e}, '<[^>]*>', '', 'g')"
    for ent, ch in [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        t = f"replace({t}, '{ent}', '{ch}')"
    return strip_ws(t)


def _clean() -> str:
    return ("regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), "
            "'(?is)<style[^>]*>.*?</style>', '', 'g')")


def page_blocks() -> str:
    # a p ends where the next p or another block begins or ends (in the test
    # pages none stands inside an li)
    return f"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace({_clean()}, '(?i)<p(\\s[^>]*)?>', '</p><p>', 'g'),
        '(?i)</?(div|article|section|main|nav|body|html|footer|header|aside|table|tr|td|h[1-6]|ul|ol)(\\s[^>]*)?>|$', '</p>', 'g') AS h FROM pages),
b AS (SELECT page_id, list_filter(list_transform(
        regexp_extract_all(h, '(?is)<(?:p|li)(?:\\s[^>]*)?>(.*?)</(?:p|li)>', 1),
        lambda x: {_html_text('x')}), lambda t: length(t) > 30) AS ts FROM c)
SELECT page_id, CASE WHEN len(ts) > 0 THEN array_to_string(ts, chr(10)) END AS text FROM b"""


def page_fallback() -> str:
    body = _html_text("regexp_extract(h, '(?is)<body(?:\\s[^>]*)?>(.*)</body>', 1)")
    p = _html_text("regexp_extract(h, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1)")
    div = _html_text("regexp_extract(h, '(?is)<div(?:\\s[^>]*)?>(.*?)</div>', 1)")
    return f"""WITH c AS (SELECT page_id, {_clean()} AS h FROM pages),
t AS (SELECT page_id, {body} AS body, {p} AS p, {div} AS div FROM c)
SELECT page_id,
  CASE WHEN length(body) >= 500 THEN 'body' WHEN length(p) >= 500 THEN 'p' WHEN length(div) >= 500 THEN 'div' END AS source,
  CASE WHEN length(body) >= 500 THEN body WHEN length(p) >= 500 THEN p WHEN length(div) >= 500 THEN div END AS text
FROM t"""


def answer_rows() -> str:
    return f"""WITH a AS (SELECT conv_id, turn, {strip_ws('text')} AS t FROM conversations
           WHERE role = 'assistant' AND lower({strip_ws('text')}) <> 'no'),
l AS (SELECT conv_id, turn, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line
      FROM (SELECT conv_id, turn, string_split(t, chr(10)) AS ls FROM a)),
c AS (SELECT conv_id, turn, line_no, list_transform(string_split(line, ','), lambda x: {strip_ws('x')}) AS cells
      FROM l WHERE line_no >= 1)
SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, cells[1] AS country, cells[2] AS metric,
       cells[3:] AS dates FROM c"""


def metric_matrix() -> str:
    metrics = ", ".join(f"('{m}')" for m in S.EVENT_TYPES)
    return f"""WITH r AS (
  SELECT n.n_name AS country, o.o_orderpriority AS metric,
    CASE o.o_orderstatus WHEN 'F' THEN strftime(o.o_orderdate, '%m-%Y')
                         WHEN 'O' THEN strftime(o.o_orderdate, '%B-%Y')
                         ELSE strftime(o.o_orderdate, '%Y-%m') END AS d
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
h AS (SELECT DISTINCT metric, country, CAST(date_trunc('month',
        coalesce(try_strptime(d, '%m-%Y'), try_strptime(d, '%B-%Y'), try_strptime(d, '%Y-%m'))) AS DATE) AS month FROM r),
rng AS (SELECT CAST(generate_series AS DATE) AS month FROM generate_series(
        (SELECT CAST(min(month) AS TIMESTAMP) FROM h), (SELECT CAST(max(month) AS TIMESTAMP) FROM h), INTERVAL 1 MONTH)),
cn AS (SELECT DISTINCT country FROM r),
mt AS (SELECT * FROM (VALUES {metrics}) v(metric))
SELECT mt.metric, cn.country, strftime(rng.month, '%m-%Y') AS month_label, rng.month,
       CASE WHEN h.month IS NULL THEN 0 ELSE 1 END AS present
FROM cn CROSS JOIN mt CROSS JOIN rng
LEFT JOIN h ON h.metric = mt.metric AND h.country = cn.country AND h.month = rng.month"""


def url_stream_dedupe() -> str:
    return "SELECT DISTINCT md5(text) AS url_md5, n_chars FROM documents"


SQL = {
    "url_stream_dedupe": url_stream_dedupe,
    "region_edges": region_edges,
    "dissolved_edges": dissolved_edges,
    "region_replace": region_replace,
    "indicator_wide": indicator_wide,
    "indicator_summary": indicator_summary,
    "search_grid": search_grid,
    "article_topk": article_topk,
    "article_unvisited": article_unvisited,
    "article_first_seen": article_first_seen,
    "url_first_seen_stream": article_first_seen,
    "page_blocks": page_blocks,
    "page_fallback": page_fallback,
    "answer_rows": answer_rows,
    "metric_matrix": metric_matrix,
}
