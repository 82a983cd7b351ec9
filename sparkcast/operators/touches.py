"""Exact ``touches`` between regions (J8): boundaries meet, interiors do not.

Regions are rings of vertices (even-odd rule: a ring inside another is a hole).
Two regions touch when their boundaries have a point in common and their
interiors none, so regions that overlap, contain one another or are equal are
no neighbours, however many vertices they share.

1. Segments are dealt to the grid cells they cross; an equi-join on the cell
   finds segments that meet. Segments that cross properly end the pair.
2. Where they don't, every segment that meets the other region is cut at the
   points where it does. The middle of each part lies inside the other region,
   outside, or on its boundary; in the last case the interiors lie on the same
   side of the part or on opposite ones. Inside or same side ends the pair.
   Rings that don't meet the other region at all are tested by one vertex.
3. Sides and inside follow from the parity of the segments that a ray along an
   axis crosses; segments are dealt to bands along both axes, so a point meets
   only those of its band (an equi-join on region, axis and band).

No pair of regions is formed that doesn't share a cell with segments that meet,
and no geometry is collected: a region of any size is rows of segments.

``eps`` is the distance within which a point lies on a segment; coordinates are
rounded to ``snap`` digits first. Rings of fewer than four points (the last is
the first) have no inside; null rings and points are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ring_segments(boundaries: DataFrame, id_col: str = "region_id", rings: str = "rings", snap: int = 6) -> DataFrame:
    """(rid, ring, k, ax, ay, bx, by): the k-th edge of each ring."""
    r = boundaries.select(F.col(id_col).alias("rid"), F.posexplode(rings).alias("ring", "pts")).where(F.size("pts") >= 2)
    n = F.size("pts") - 1
    e = F.arrays_zip(F.slice("pts", 1, n).alias("p"), F.slice("pts", 2, n).alias("q"))
    return (r.select("rid", "ring", F.posexplode(e).alias("k", "e"))
            .select("rid", "ring", "k", F.round("e.p.x", snap).alias("ax"), F.round("e.p.y", snap).alias("ay"),
                    F.round("e.q.x", snap).alias("bx"), F.round("e.q.y", snap).alias("by"))
            .where("ax <> bx OR ay <> by"))


def _cells(seg: DataFrame, cell: float, eps: float) -> DataFrame:
    """Each segment once for each grid cell it crosses."""
    at = lambda x: F.floor(x / F.lit(cell)).cast("long")
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    seg = seg.select("*", F.explode(F.sequence(at(low - eps), at(high + eps))).alias("cx"))
    slope = F.when(F.col("ax") != F.col("bx"), (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    left = F.least(F.greatest(low, F.col("cx") * F.lit(cell)), high)
    right = F.greatest(F.least(high, (F.col("cx") + 1) * F.lit(cell)), low)
    y0 = F.coalesce(F.col("ay") + slope * (left - F.col("ax")), F.col("ay"))
    y1 = F.coalesce(F.col("ay") + slope * (right - F.col("ax")), F.col("by"))
    return seg.select("*", F.explode(F.sequence(at(F.least(y0, y1) - eps), at(F.greatest(y0, y1) + eps))).alias("cy"))


def _off(a: str, b: str, p: str) -> str:
    """Signed distance of point p from the line through a and b, as SQL."""
    return f"(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x)) / sqrt(({b}x - {a}x) * ({b}x - {a}x) + ({b}y - {a}y) * ({b}y - {a}y))"


def _along(a: str, b: str, p: str) -> str:
    """Where p lies along the segment from a (0) to b (1), as SQL."""
    return f"(({b}x - {a}x) * ({p}x - {a}x) + ({b}y - {a}y) * ({p}y - {a}y)) / (({b}x - {a}x) * ({b}x - {a}x) + ({b}y - {a}y) * ({b}y - {a}y))"


def _meetings(seg: DataFrame, cell: float, eps: float) -> DataFrame:
    """One row for each pair of segments of two regions that meet: whether they
    cross, and where along each the other's ends lie on it."""
    # a segment is few bytes but many pairs: read as they lie, all segments would be one task's
    s = _cells(seg.repartition(int(seg.sparkSession.conf.get("spark.sql.shuffle.partitions"))), cell, eps)
    t = s.select(F.col("rid").alias("tid"), F.col("ring").alias("tring"), F.col("k").alias("tk"), F.col("ax").alias("cx_"), F.col("ay").alias("cy_"),
                 F.col("bx").alias("dx_"), F.col("by").alias("dy_"), "cx", "cy")
    t = t.toDF("tid", "tring", "tk", "Cx", "Cy", "Dx", "Dy", "gx", "gy")
    s = s.toDF("rid", "ring", "k", "Ax", "Ay", "Bx", "By", "gx", "gy")
    # boxes that are apart by more than what counts as on a segment (eps across, eps of its length along) don't meet
    reach = F.lit(4 * eps) * F.expr("1 + abs(Bx - Ax) + abs(By - Ay) + abs(Dx - Cx) + abs(Dy - Cy)")
    beside = [F.expr(f"greatest(least(A{x}, B{x}) - greatest(C{x}, D{x}), least(C{x}, D{x}) - greatest(A{x}, B{x}))") <= reach for x in "xy"]
    j = s.join(t, ["gx", "gy"]).where("rid < tid").where(beside[0]).where(beside[1]).drop("gx", "gy")
    # What is left goes through array functions a pair at a time: as columns, each of
    # these is copied into those built on it, and the join's code grows beyond what is compiled.
    ends = (("c", "A", "B", "C"), ("d", "A", "B", "D"), ("a", "C", "D", "A"), ("b", "C", "D", "B"))
    at = ", ".join(f"'{p}', named_struct('off', {_off(f'z.{a}', f'z.{b}', f'z.{q}')}, 'along', {_along(f'z.{a}', f'z.{b}', f'z.{q}')})" for p, a, b, q in ends)
    on = ", ".join(f"'{p}_at', if(abs(z.{p}.off) <= {eps}D AND z.{p}.along >= -{eps}D AND z.{p}.along <= 1 + {eps}D, least(greatest(z.{p}.along, 0D), 1D), NULL)" for p, *_ in ends)
    parted = lambda x, y: f"((z.{x}.off > {eps}D AND z.{y}.off < -{eps}D) OR (z.{x}.off < -{eps}D AND z.{y}.off > {eps}D))"
    points = ", ".join(f"'{p}{x}', {p}{x}" for p in "ABCD" for x in "xy")
    hits = f"""filter(transform(transform(array(named_struct({points})), z -> named_struct({at})),
                                z -> named_struct({on}, 'crossing', {parted("c", "d")} AND {parted("a", "b")})),
                      z -> z.crossing OR coalesce(z.c_at, z.d_at, z.a_at, z.b_at) IS NOT NULL)"""
    return j.select("*", F.explode(F.expr(hits)).alias("z")).select(*j.columns, "z.*")


def _middles(met: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """(r, o, mx, my, axis): middles of the parts of r's segments between the
    points where they meet o; axis: that of the ray that leaves the part aside."""
    one = lambda r, o, ring, k, a, b, cuts, touch: met.select(
        F.col(r).alias("r"), F.col(o).alias("o"), F.col(ring).alias("ring"), F.col(k).alias("k"),
        *[F.col(f"{p}{x}").alias(f"{q}{x}") for p, q in ((a, "A"), (b, "B")) for x in "xy"],
        F.explode(F.filter(F.array(*cuts, F.when(touch, F.lit(0.0))), lambda v: v.isNotNull())).alias("t"))
    any_at = F.expr("coalesce(c_at, d_at, a_at, b_at) IS NOT NULL")
    cuts = (one("rid", "tid", "ring", "k", "A", "B", ["c_at", "d_at"], any_at)
            .unionByName(one("tid", "rid", "tring", "tk", "C", "D", ["a_at", "b_at"], any_at)))
    cuts = cuts.join(pairs, ["r", "o"], "left_semi")
    parts = (cuts.groupBy("r", "o", "ring", "k", "Ax", "Ay", "Bx", "By")
             .agg(F.array_sort(F.array_union(F.collect_set("t"), F.array(F.lit(0.0), F.lit(1.0)))).alias("t")))
    n = F.size("t") - 1
    parts = (parts.select("*", F.explode(F.arrays_zip(F.slice("t", 1, n).alias("u"), F.slice("t", 2, n).alias("v"))).alias("p"))
             .where(F.col("p.v") - F.col("p.u") > eps).withColumn("m", (F.col("p.u") + F.col("p.v")) / 2))
    return parts.select("r", "o", F.expr("Ax + m * (Bx - Ax)").alias("mx"), F.expr("Ay + m * (By - Ay)").alias("my"),
                        F.expr("CASE WHEN abs(By - Ay) >= abs(Bx - Ax) THEN 'x' ELSE 'y' END").alias("axis"))


def _banded(seg: DataFrame, band: float, eps: float) -> DataFrame:
    """Segments by the bands they cross along each axis; u is the ray's axis, v across."""
    flat = lambda axis, a, b, c, d: seg.select("rid", F.lit(axis).alias("axis"), F.col(a).alias("u0"), F.col(b).alias("v0"), F.col(c).alias("u1"), F.col(d).alias("v1"))
    both = flat("x", "ax", "ay", "bx", "by").unionByName(flat("y", "ay", "ax", "by", "bx"))
    at = lambda x: F.floor(x / F.lit(band)).cast("long")
    return both.select("*", F.explode(F.sequence(at(F.least("v0", "v1") - eps), at(F.greatest("v0", "v1") + eps))).alias("band"))


def _located(points: DataFrame, banded: DataFrame, band: float, eps: float) -> DataFrame:
    """(r, o, mx, my, axis, rid, on, odd) for points with the region ``rid`` to
    test: whether the point lies on its boundary, and the parity of the other
    segments that the ray from it crosses."""
    p = points.withColumns({"u": F.expr("CASE axis WHEN 'x' THEN mx ELSE my END"), "v": F.expr("CASE axis WHEN 'x' THEN my ELSE mx END")})
    p = p.withColumn("band", F.floor(F.col("v") / F.lit(band)).cast("long"))
    j = p.join(banded, ["rid", "axis", "band"], "left")
    off = F.expr("abs((u1 - u0) * (v - v0) - (v1 - v0) * (u - u0)) / sqrt((u1 - u0) * (u1 - u0) + (v1 - v0) * (v1 - v0))")
    along = F.expr("((u1 - u0) * (u - u0) + (v1 - v0) * (v - v0)) / ((u1 - u0) * (u1 - u0) + (v1 - v0) * (v1 - v0))")
    on = F.coalesce((off <= eps) & (along >= -eps) & (along <= 1 + eps), F.lit(False))
    hit = F.coalesce(F.expr("((v0 <= v AND v < v1) OR (v1 <= v AND v < v0)) AND u < u0 + (v - v0) / (v1 - v0) * (u1 - u0)"), F.lit(False))
    return (j.groupBy("r", "o", "mx", "my", "axis", "rid")
            .agg(F.max(on).alias("on"), (F.sum((hit & ~on).cast("int")) % 2 == 1).alias("odd")))


def touching(boundaries: DataFrame, id_col: str = "region_id", rings: str = "rings", snap: int = 6,
             cell: float = 0.1, eps: float = 1e-9) -> DataFrame:
    """``(region_id, neighbour_id)`` of regions that touch; symmetric, each
    pair once, no self pairs. ``cell``: size of grid cells and bands, a few
    times the usual length of a segment."""
    from ..session import materialize
    seg = materialize(ring_segments(boundaries, id_col, rings, snap))
    met = materialize(_meetings(seg, cell, eps))
    once = met.groupBy("rid", "tid").agg(F.max("crossing").alias("crossing")).where("NOT crossing").select("rid", "tid")
    once = materialize(once)
    pairs = once.toDF("r", "o").unionByName(once.toDF("o", "r"))
    # rings of r that don't meet o: all of them lies inside, or outside
    with_ring = met.select(F.col("rid").alias("r"), F.col("tid").alias("o"), "ring").unionByName(met.select(F.col("tid").alias("r"), F.col("rid").alias("o"), F.col("tring").alias("ring")))
    first = seg.groupBy(F.col("rid").alias("r"), "ring").agg(F.min(F.struct("k", "ax", "ay")).alias("p"))
    alone = (pairs.join(first, "r").join(with_ring.distinct(), ["r", "o", "ring"], "left_anti")
             .select("r", "o", F.col("p.ax").alias("mx"), F.col("p.ay").alias("my"), F.lit("x").alias("axis")))
    points = materialize(_middles(met, pairs, eps).unionByName(alone).distinct())
    tests = points.withColumn("rid", F.explode(F.array("r", "o")))
    found = _located(tests, _banded(seg, cell, eps), cell, eps)
    own = found.where("rid = r").select("r", "o", "mx", "my", "axis", F.col("odd").alias("r_odd"))
    other = found.where("rid = o").select("r", "o", "mx", "my", "axis", "on", "odd")
    inner = (other.join(own, ["r", "o", "mx", "my", "axis"]).where("(NOT on AND odd) OR (on AND odd = r_odd)")
             .select(F.least("r", "o").alias("rid"), F.greatest("r", "o").alias("tid")).distinct())
    kept = once.join(inner, ["rid", "tid"], "left_anti")
    return kept.toDF("region_id", "neighbour_id").unionByName(kept.select(F.col("tid").alias("region_id"), F.col("rid").alias("neighbour_id")))
