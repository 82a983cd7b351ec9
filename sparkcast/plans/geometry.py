"""Registered query of the exact adjacency (J8) and its oracle SQL.

Stand-in: every customer is a region of its own size near (2 x nation key,
customer key div 10): rectangles, triangles and rectangles with a hole, so that
regions touch along borders, at corners and in T-junctions, overlap, nest, fill
holes and are equal. The set grows with the customer table at a constant density."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.touches import touching
from . import standins as S


def shapes(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    c = S.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").withColumns({
        "x": (F.col("c_nationkey") * 2).cast("double"), "y": F.expr("cast(c_custkey div 10 as double)"),
        "w": (k % 4 + 1).cast("double"), "h": F.expr("cast(c_custkey div 4 % 4 + 1 as double)")})
    pt = lambda a, b: F.expr(f"named_struct('x', {a}, 'y', {b})")
    box = lambda a, b, c, d: F.array(pt(a, b), pt(c, b), pt(c, d), pt(a, d), pt(a, b))
    outer, hole = box("x", "y", "x + w", "y + h"), box("x + 1", "y + 1", "x + w - 1", "y + h - 1")
    triangle = F.array(pt("x", "y"), pt("x + w", "y"), pt("x", "y + h"), pt("x", "y"))
    return c.select(k.alias("region_id"), F.when(k % 6 == 4, F.array(triangle)).when((F.col("w") > 2) & (F.col("h") > 2), F.array(outer, hole))
                    .otherwise(F.array(outer)).alias("rings"))


def region_touches(spark, sf_dir) -> DataFrame:
    return touching(shapes(spark, sf_dir), cell=4.0)


def region_touches_sql() -> str:
    """Every pair of regions whose boxes meet, every pair of their segments; no grid and no bands."""
    return """
WITH c AS (SELECT c_custkey AS r, CAST(c_nationkey * 2 AS DOUBLE) AS x, CAST(c_custkey // 10 AS DOUBLE) AS y,
                  CAST(c_custkey % 4 + 1 AS DOUBLE) AS w, CAST(c_custkey // 4 % 4 + 1 AS DOUBLE) AS h FROM customer),
corner AS (
  SELECT r, 0 AS ring, unnest([1, 2, 3, 4]) AS k, unnest([x, x + w, x, x]) AS px, unnest([y, y, y + h, y]) AS py FROM c WHERE r % 6 = 4
  UNION ALL SELECT r, 0, unnest([1, 2, 3, 4, 5]), unnest([x, x + w, x + w, x, x]), unnest([y, y, y + h, y + h, y]) FROM c WHERE r % 6 <> 4
  UNION ALL SELECT r, 1, unnest([1, 2, 3, 4, 5]), unnest([x + 1, x + w - 1, x + w - 1, x + 1, x + 1]), unnest([y + 1, y + 1, y + h - 1, y + h - 1, y + 1])
  FROM c WHERE r % 6 <> 4 AND w > 2 AND h > 2),
seg AS (SELECT p.r, p.ring, p.k, p.px AS ax, p.py AS ay, q.px AS bx, q.py AS b_y FROM corner p JOIN corner q ON q.r = p.r AND q.ring = p.ring AND q.k = p.k + 1),
box AS (SELECT r, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM seg GROUP BY r),
pair AS (SELECT a.r, b.r AS o FROM box a JOIN box b ON a.r <> b.r AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
met AS (SELECT p.r, p.o, s.ring, s.k, s.ax, s.ay, s.bx, s.b_y, t.ax AS cx, t.ay AS cy, t.bx AS dx, t.b_y AS dy,
               (s.bx - s.ax) * (t.ay - s.ay) - (s.b_y - s.ay) * (t.ax - s.ax) AS oc, (s.bx - s.ax) * (t.b_y - s.ay) - (s.b_y - s.ay) * (t.bx - s.ax) AS od,
               (t.bx - t.ax) * (s.ay - t.ay) - (t.b_y - t.ay) * (s.ax - t.ax) AS oa, (t.bx - t.ax) * (s.b_y - t.ay) - (t.b_y - t.ay) * (s.bx - t.ax) AS ob
        FROM pair p JOIN seg s ON s.r = p.r JOIN seg t ON t.r = p.o),
hit AS (SELECT *, oc * od < 0 AND oa * ob < 0 AS crossing,
               oc = 0 AND cx BETWEEN least(ax, bx) AND greatest(ax, bx) AND cy BETWEEN least(ay, b_y) AND greatest(ay, b_y) AS c_on,
               od = 0 AND dx BETWEEN least(ax, bx) AND greatest(ax, bx) AND dy BETWEEN least(ay, b_y) AND greatest(ay, b_y) AS d_on,
               oa = 0 AND ax BETWEEN least(cx, dx) AND greatest(cx, dx) AND ay BETWEEN least(cy, dy) AND greatest(cy, dy) AS a_on,
               ob = 0 AND bx BETWEEN least(cx, dx) AND greatest(cx, dx) AND b_y BETWEEN least(cy, dy) AND greatest(cy, dy) AS b_on FROM met),
ok AS (SELECT r, o FROM hit GROUP BY r, o HAVING bool_or(c_on OR d_on OR a_on OR b_on) AND NOT bool_or(crossing)),
cut AS (SELECT DISTINCT r, o, ring, k, ax, ay, bx, b_y, t FROM (
          SELECT r, o, ring, k, ax, ay, bx, b_y, unnest([0.0, 1.0,
                 CASE WHEN c_on THEN ((bx - ax) * (cx - ax) + (b_y - ay) * (cy - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) END,
                 CASE WHEN d_on THEN ((bx - ax) * (dx - ax) + (b_y - ay) * (dy - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) END]) AS t FROM hit SEMI JOIN ok USING (r, o)) WHERE t IS NOT NULL),
part AS (SELECT *, lead(t) OVER (PARTITION BY r, o, ring, k ORDER BY t) AS u FROM cut),
mid AS (SELECT DISTINCT r, o, ax + (t + u) / 2 * (bx - ax) AS mx, ay + (t + u) / 2 * (b_y - ay) AS my, abs(b_y - ay) >= abs(bx - ax) AS upright FROM part WHERE u IS NOT NULL),
test AS (SELECT m.*, s.r AS rid, (s.bx - s.ax) * (my - s.ay) - (s.b_y - s.ay) * (mx - s.ax) = 0 AND mx BETWEEN least(s.ax, s.bx) AND greatest(s.ax, s.bx)
                AND my BETWEEN least(s.ay, s.b_y) AND greatest(s.ay, s.b_y) AS on_it,
                CASE WHEN upright THEN ((s.ay <= my AND my < s.b_y) OR (s.b_y <= my AND my < s.ay)) AND mx < s.ax + (my - s.ay) / (s.b_y - s.ay) * (s.bx - s.ax)
                     ELSE ((s.ax <= mx AND mx < s.bx) OR (s.bx <= mx AND mx < s.ax)) AND my < s.ay + (mx - s.ax) / (s.bx - s.ax) * (s.b_y - s.ay) END AS ray
         FROM mid m JOIN seg s ON s.r IN (m.r, m.o)),
side AS (SELECT r, o, mx, my, upright, bool_or(on_it) FILTER (WHERE rid = o) AS on_o, count(*) FILTER (WHERE rid = o AND ray AND NOT on_it) % 2 AS odd_o,
                count(*) FILTER (WHERE rid = r AND ray AND NOT on_it) % 2 AS odd_r FROM test GROUP BY ALL),
bad AS (SELECT DISTINCT r, o FROM side WHERE (NOT on_o AND odd_o = 1) OR (on_o AND odd_o = odd_r))
SELECT r AS region_id, o AS neighbour_id FROM ok ANTI JOIN bad b ON (b.r = ok.r AND b.o = ok.o) OR (b.r = ok.o AND b.o = ok.r)
"""


QUERIES = {"region_touches": region_touches}
SQL = {"region_touches": region_touches_sql}
