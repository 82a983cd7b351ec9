"""DuckDB oracle SQL for the panel queries (independent brute-force form:
cross-joined grid, FILTER counts, band self-join for adjacency)."""

from __future__ import annotations

from ..cols import lag_name, neighbour_name
from . import standins as S


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _base_ctes() -> str:
    cnt = ",\n    ".join(f"count(*) FILTER (WHERE event_type = {lit(v)}) AS {q(v)}" for v in S.EVENT_TYPES)
    sub = ",\n    ".join(f"count(*) FILTER (WHERE sub_event_type = {lit(v)}) AS {q(v)}" for v in S.SUB_EVENT_TYPES)
    nb = ",\n    ".join(f"count(*) FILTER (WHERE event_type = {lit(v)}) AS {q(neighbour_name(v))}"
                       for v in S.EVENT_TYPES)
    return f"""
ev AS (
  SELECT c.c_nationkey AS region_id, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month,
         o.o_orderpriority AS event_type, o.o_orderstatus AS sub_event_type
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderdate >= TIMESTAMP '{S.START_YEAR:04d}-01-01'),
regions AS (SELECT DISTINCT region_id FROM ev WHERE region_id IS NOT NULL),
months AS (SELECT DISTINCT month FROM ev),
grid AS (SELECT region_id, month FROM regions CROSS JOIN months),
cells AS (SELECT n_nationkey AS rid, n_regionkey AS x, n_nationkey // 5 AS y FROM nation),
edges AS (SELECT a.rid AS region_id, b.rid AS neighbour_id FROM cells a JOIN cells b
          ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.rid <> b.rid),
cnt AS (SELECT region_id, month,
    {cnt}
  FROM ev WHERE region_id IS NOT NULL GROUP BY region_id, month),
sub AS (SELECT region_id, month,
    {sub}
  FROM ev WHERE region_id IS NOT NULL GROUP BY region_id, month),
nb AS (SELECT e.region_id, ev.month,
    {nb}
  FROM ev JOIN edges e ON ev.region_id = e.neighbour_id GROUP BY e.region_id, ev.month)"""


def _count_cols():
    return S.EVENT_TYPES + S.SUB_EVENT_TYPES + [neighbour_name(v) for v in S.EVENT_TYPES]


def _full_ctes() -> str:
    cols = _count_cols()
    filled = ",\n    ".join(f"CAST(coalesce({q(x)}, 0) AS BIGINT) AS {q(x)}" for x in cols)
    lags = ",\n    ".join(
        f"lag({q(x)}, {S.LAG}) OVER (PARTITION BY region_id ORDER BY month) AS {q(lag_name(x, S.LAG))}"
        for x in cols)
    dummies = ",\n    ".join([f"CAST(month(month) = {k} AS INTEGER) AS month_{k}" for k in range(2, 13)]
                             + [f"CAST(quarter(month) = {k} AS INTEGER) AS quarter_{k}" for k in (2, 3, 4)])
    return _base_ctes() + f""",
base AS (SELECT g.region_id, g.month,
    {filled}
  FROM grid g LEFT JOIN cnt USING (region_id, month) LEFT JOIN sub USING (region_id, month)
       LEFT JOIN nb USING (region_id, month)),
lagged AS (SELECT *,
    {lags}
  FROM base),
feat AS (SELECT l.*,
    CAST((year(month) - {S.START_YEAR}) * 12 + month(month) - 1 AS INTEGER) AS linear_month_trend,
    CAST(year(month) AS INTEGER) AS "year",
    {dummies},
    exp(-{S.DECAY} * ((year(mx.m) - year(month)) * 12 + month(mx.m) - month(month))) AS importance_weight
  FROM lagged l CROSS JOIN (SELECT max(month) AS m FROM months) mx)"""


def monthly_event_panel() -> str:
    sel = ", ".join(f"CAST(coalesce(cnt.{q(v)}, 0) AS BIGINT) AS {q(v)}" for v in S.EVENT_TYPES)
    return f"WITH {_base_ctes()}\nSELECT g.region_id, g.month, {sel}\nFROM grid g LEFT JOIN cnt USING (region_id, month)"


def monthly_subevent_panel() -> str:
    sel = ", ".join(f"CAST(coalesce(sub.{q(v)}, 0) AS BIGINT) AS {q(v)}" for v in S.SUB_EVENT_TYPES)
    return f"WITH {_base_ctes()}\nSELECT g.region_id, g.month, {sel}\nFROM grid g LEFT JOIN sub USING (region_id, month)"


def neighbour_event_sums() -> str:
    sel = ", ".join(f"CAST(coalesce(nb.{q(neighbour_name(v))}, 0) AS BIGINT) AS {q(neighbour_name(v))}"
                    for v in S.EVENT_TYPES)
    return f"WITH {_base_ctes()}\nSELECT g.region_id, g.month, {sel}\nFROM grid g LEFT JOIN nb USING (region_id, month)"


def lagged_panel() -> str:
    cols = _count_cols()
    sel = ", ".join([q(x) for x in cols] + [q(lag_name(x, S.LAG)) for x in cols])
    return f"WITH {_full_ctes()}\nSELECT region_id, month, {sel} FROM feat"


def trend_features() -> str:
    names = ["linear_month_trend", "year"] + [f"month_{k}" for k in range(2, 13)] + \
            [f"quarter_{k}" for k in (2, 3, 4)]
    return f"WITH {_full_ctes()}\nSELECT region_id, month, {', '.join(q(x) for x in names)} FROM feat"


def importance_weights() -> str:
    return f"WITH {_full_ctes()}\nSELECT region_id, month, round(importance_weight, 9) AS importance_weight FROM feat"


def model_table() -> str:
    from .panel_queries import predictors
    preds = predictors()
    cols = [q(x) if x != "importance_weight" else "round(importance_weight, 9) AS importance_weight"
            for x in preds]
    cols += [q(t) for t in S.TARGETS if t not in preds]
    return f"WITH {_full_ctes()}\nSELECT region_id, month, {', '.join(cols)} FROM feat"


def holdout_split() -> str:
    return f"""WITH {_full_ctes()},
r AS (SELECT region_id, month, row_number() OVER (PARTITION BY region_id ORDER BY month DESC) AS rn FROM feat)
SELECT region_id, month, CASE WHEN rn <= {S.HOLDOUT} THEN 'test' ELSE 'train' END AS split,
       CASE WHEN rn <= {S.HOLDOUT} THEN CAST({S.HOLDOUT} + 1 - rn AS INTEGER) END AS step
FROM r"""


def stored_panel() -> str:
    sel = ", ".join([q(x) for x in S.EVENT_TYPES] + [q(lag_name(x, S.LAG)) for x in S.EVENT_TYPES])
    return f"""WITH {_full_ctes()},
r AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY month DESC) AS rn FROM feat)
SELECT region_id, month, {sel}, CASE WHEN rn <= {S.HOLDOUT} THEN 'test' ELSE 'train' END AS split,
       CASE WHEN rn <= {S.HOLDOUT} THEN CAST({S.HOLDOUT} + 1 - rn AS INTEGER) END AS step
FROM r"""


def persistence_eval() -> str:
    unions = "\n  UNION ALL ".join(
        f"SELECT region_id, {lit(t)} AS target, CAST({q(t)} AS DOUBLE) AS y, "
        f"CAST({q(lag_name(t, S.LAG))} AS DOUBLE) AS yh FROM test" for t in S.TARGETS)
    return f"""WITH {_full_ctes()},
r AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY month DESC) AS rn FROM feat),
test AS (SELECT * FROM r WHERE rn <= {S.HOLDOUT}),
lt AS ({unions})
SELECT region_id, target, round(avg(abs(y - yh)), 9) AS mae,
       round(avg(CASE WHEN y <> 0 THEN abs((y - yh) / y) END) * 100, 9) AS mape,
       count(*) AS n_test
FROM lt GROUP BY region_id, target"""


def rf_weighted_mean() -> str:
    from .panel_queries import predictors
    known = " AND ".join(f"{q(x)} IS NOT NULL" for x in predictors())
    unions = "\n  UNION ALL ".join(
        f"SELECT region_id, month, {lit(t)} AS target, CAST({S.HOLDOUT} + 1 - rn AS INTEGER) AS step, CAST({q(t)} AS DOUBLE) AS actual, "
        f"round((SELECT sum(importance_weight * {q(t)}) / sum(importance_weight) FROM r WHERE n > {S.HOLDOUT} AND rn > {S.HOLDOUT} AND {known}), 6) AS predicted "
        f"FROM r WHERE n > {S.HOLDOUT} AND rn <= {S.HOLDOUT}" for t in S.TARGETS)
    return f"""WITH {_full_ctes()},
r AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY month DESC) AS rn, count(*) OVER (PARTITION BY region_id) AS n FROM feat)
{unions}"""


def _tree_level(k: int) -> str:
    """CTEs of one level: rows of t{k} with their node go on to t{k + 1}."""
    return f"""
e{k} AS (SELECT *, sum(w) OVER n AS ww, sum(w * y) OVER n AS s, sum(w * y * y) OVER n AS q, sum(w) OVER o AS wl, sum(w * y) OVER o AS sl,
                lead(CASE WHEN w > 0 THEN v END IGNORE NULLS) OVER o AS nx
         FROM t{k} JOIN x USING (region_id, month)
         WINDOW n AS (PARTITION BY region_id, target, node, f), o AS (PARTITION BY region_id, target, node, f ORDER BY v)),
c{k} AS (SELECT region_id, target, node, f, (v + nx) / 2 AS thr,
                round((sl * sl / wl + (s - sl) * (s - sl) / (ww - wl) - s * s / ww) / (q - s * s / ww), 9) AS gain
         FROM e{k} WHERE w > 0 AND nx > v AND ww > wl AND wl > 0 AND q - s * s / ww > 1e-9),
b{k} AS (SELECT * FROM c{k} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY region_id, target, node ORDER BY gain DESC, f, thr) = 1),
t{k + 1} AS (SELECT t.region_id, t.month, t.target, t.test, t.step, t.y, t.w,
                    CASE WHEN b.f IS NULL THEN t.node ELSE t.node * 2 + CAST(coalesce(x.v > b.thr, false) AS INT) END AS node
             FROM t{k} t LEFT JOIN b{k} b USING (region_id, target, node) LEFT JOIN x ON x.region_id = t.region_id AND x.month = t.month AND x.f = b.f)"""


def region_tree() -> str:
    from .panel_queries import predictors
    preds = predictors()
    known = " AND ".join(f"{q(x)} IS NOT NULL" for x in preds)
    rows = "\n  UNION ALL ".join(
        f"SELECT region_id, month, {lit(t)} AS target, rn <= {S.HOLDOUT} AS test, CASE WHEN rn <= {S.HOLDOUT} THEN CAST({S.HOLDOUT} + 1 - rn AS INTEGER) END AS step, "
        f"CAST({q(t)} AS DOUBLE) AS y, CASE WHEN rn <= {S.HOLDOUT} THEN 0.0 ELSE importance_weight END AS w, 1 AS node "
        f"FROM r WHERE rn <= {S.HOLDOUT} OR ({known})" for t in S.TARGETS)
    values = "\n  UNION ALL ".join(f"SELECT region_id, month, {i} AS f, CAST({q(x)} AS DOUBLE) AS v FROM r" for i, x in enumerate(preds))
    return f"""WITH {_full_ctes()},
r AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY month DESC) AS rn FROM feat),
x AS ({values}),
t0 AS ({rows}),{_tree_level(0)},{_tree_level(1)},
p AS (SELECT *, sum(w * y) OVER l / sum(w) OVER l AS predicted FROM t2 WINDOW l AS (PARTITION BY region_id, target, node))
SELECT region_id, month, target, step, y AS actual, round(predicted, 6) AS predicted FROM p WHERE test AND predicted IS NOT NULL"""


SQL = {
    "stored_panel": stored_panel,
    "incremental_panel": lagged_panel,
    "region_tree": region_tree,
    "monthly_event_panel": monthly_event_panel,
    "monthly_subevent_panel": monthly_subevent_panel,
    "neighbour_event_sums": neighbour_event_sums,
    "lagged_panel": lagged_panel,
    "trend_features": trend_features,
    "importance_weights": importance_weights,
    "model_table": model_table,
    "holdout_split": holdout_split,
    "persistence_eval": persistence_eval,
    "rf_weighted_mean": rf_weighted_mean,
}
