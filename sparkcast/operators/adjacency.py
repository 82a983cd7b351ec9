"""Region adjacency without a geometry library.

Polygons are rings of ``struct<x double, y double>`` vertices. Two regions
touch when they share a vertex after snapping coordinates to a grid
(``round(x, snap)``): on topologically clean boundaries a shared border or a
shared corner always shares vertices. With a grid size, a vertex lying on the
other polygon's edge without a vertex there (a T-junction) counts too.

At scale the vertex table is one row per (region, distinct vertex); the
self join is an equi-join on the snapped vertex, shuffled by vertex, with
AQE splitting a hot vertex partition. The edge table is small (regions x
average degree) and is what every later step uses -- no geometry is carried
further.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F



def square_rings(df: DataFrame, id_col: str, x: str, y: str, size: float = 1.0) -> DataFrame:
    """Axis-aligned squares with lower-left corner (x, y): one closed ring each.

    Used to derive boundary stand-ins from table columns and for goldens.
    """
    x0, y0 = F.col(x).cast("double"), F.col(y).cast("double")
    x1, y1 = x0 + F.lit(size), y0 + F.lit(size)

    def pt(a, b):
        return F.struct(a.alias("x"), b.alias("y"))

    ring = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
    return df.select(F.col(id_col).alias("region_id"), F.array(ring).alias("rings"))


def vertices(boundaries: DataFrame, id_col: str = "region_id", rings: str = "rings",
             snap: int = 6) -> DataFrame:
    """Distinct snapped vertices per region."""
    return (boundaries.select(F.col(id_col).alias("rid"), F.explode(rings).alias("ring"))
            .select("rid", F.explode("ring").alias("p"))
            .select("rid", F.round(F.col("p.x"), snap).alias("vx"),
                    F.round(F.col("p.y"), snap).alias("vy"))
            .distinct())


def edges_from_rings(boundaries: DataFrame, id_col: str = "region_id",
                     rings: str = "rings", snap: int = 6, cell: float | None = None,
                     overlaps: DataFrame | None = None) -> DataFrame:
    """J8 ``touches`` self join as an edge table ``(region_id, neighbour_id)``:
    symmetric, no self pairs, each pair once. Islands have no rows.

    Shared (snapped) vertices always count. With ``cell`` (a grid size in
    coordinate units, e.g. 0.1 degrees) a vertex lying on another region's
    edge without a vertex there (a T-junction) counts too: segments are
    bucketed into the grid cells they cross and joined to the
    vertices of the same cell, then tested exactly for point-on-segment.

    ``overlaps`` (parent_id, child_id): regions known to contain others, which
    share border vertices without touching; such pairs are no edges.
    """
    if overlaps is not None:
        e = edges_from_rings(boundaries, id_col, rings, snap, cell)
        o = overlaps.select(F.col("parent_id").alias("region_id"), F.col("child_id").alias("neighbour_id"))
        o = o.unionByName(o.select(F.col("neighbour_id").alias("region_id"), F.col("region_id").alias("neighbour_id")))
        return e.join(o, ["region_id", "neighbour_id"], "left_anti")
    v = vertices(boundaries, id_col, rings, snap)
    a = v.select(F.col("rid").alias("region_id"), "vx", "vy")
    b = v.select(F.col("rid").alias("neighbour_id"), "vx", "vy")
    shared = (a.join(b, ["vx", "vy"])
              .where(F.col("region_id") != F.col("neighbour_id"))
              .select("region_id", "neighbour_id"))
    if cell is None:
        return shared.distinct()
    t = t_junction_pairs(boundaries, v, id_col, rings, snap, cell)
    return shared.unionByName(t).unionByName(
        t.select(F.col("neighbour_id").alias("region_id"), F.col("region_id").alias("neighbour_id"))).distinct()


def segments(boundaries: DataFrame, id_col: str = "region_id", rings: str = "rings",
             snap: int = 6) -> DataFrame:
    """Ring edges ``(sid, ax, ay, bx, by)`` from consecutive vertices."""
    # each ring zipped with itself shifted by one: consecutive vertex pairs,
    # built inside the row (no shuffle)
    r = boundaries.select(F.col(id_col).alias("sid"), F.explode(rings).alias("ring"))
    n = F.size("ring") - 1
    pairs = F.arrays_zip(F.slice("ring", 1, n).alias("p"), F.slice("ring", 2, n).alias("q"))
    return (r.where(F.size("ring") >= 2).select("sid", F.explode(pairs).alias("e"))
            .select("sid", F.round("e.p.x", snap).alias("ax"), F.round("e.p.y", snap).alias("ay"),
                    F.round("e.q.x", snap).alias("bx"), F.round("e.q.y", snap).alias("by"))
            .where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))))


def t_junction_pairs(boundaries: DataFrame, v: DataFrame, id_col: str, rings: str, snap: int,
                     cell: float, eps: float = 1e-9) -> DataFrame:
    """Pairs (vertex owner, segment owner) where a vertex lies on the other
    region's segment, found through grid cells (no all-pairs comparison)."""
    seg = segments(boundaries, id_col, rings, snap)

    def cidx(col):
        return F.floor(col / F.lit(cell)).cast("long")

    seg = seg.select("*", F.explode(F.sequence(cidx(F.least("ax", "bx")), cidx(F.greatest("ax", "bx")))).alias("cx"))
    # in a column of cells only those between the segment's entry and exit
    slope = F.when(F.col("ax") != F.col("bx"), (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    left = F.greatest(F.least("ax", "bx"), F.col("cx") * F.lit(cell))
    right = F.least(F.greatest("ax", "bx"), (F.col("cx") + 1) * F.lit(cell))
    y0 = F.coalesce(F.col("ay") + slope * (left - F.col("ax")), F.col("ay"))
    y1 = F.coalesce(F.col("ay") + slope * (right - F.col("ax")), F.col("by"))
    seg = seg.select("*", F.explode(F.sequence(cidx(F.least(y0, y1) - F.lit(eps)), cidx(F.greatest(y0, y1) + F.lit(eps)))).alias("cy"))
    pv = v.select("rid", "vx", "vy", cidx(F.col("vx")).alias("cx"), cidx(F.col("vy")).alias("cy"))
    j = pv.join(seg, ["cx", "cy"]).where(F.col("rid") != F.col("sid"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    px, py = F.col("vx") - F.col("ax"), F.col("vy") - F.col("ay")
    cross = dx * py - dy * px
    dot = dx * px + dy * py
    length2 = dx * dx + dy * dy
    on = (F.abs(cross) <= F.lit(eps) * F.sqrt(length2)) & (dot >= 0) & (dot <= length2)
    return j.where(on).select(F.col("rid").alias("region_id"), F.col("sid").alias("neighbour_id"))


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """The neighbour set per region (a view; the edge table is the data)."""
    return edges.groupBy("region_id").agg(F.array_sort(F.collect_set("neighbour_id")).alias("neighbours"))


def dissolve_edges(edges: DataFrame, parent_map: DataFrame,
                   child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """A7 re-aimed on edges: merging children into their parent gives the
    parent every outside neighbour of any child. Regions without a parent
    keep their id; internal edges (same parent) disappear."""
    pm = parent_map.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).distinct()
    l = (edges.join(pm, F.col("region_id") == F.col("_c"), "left")
         .select(F.coalesce("_p", "region_id").alias("region_id"), "neighbour_id"))
    r = (l.join(pm, F.col("neighbour_id") == F.col("_c"), "left")
         .select("region_id", F.coalesce("_p", "neighbour_id").alias("neighbour_id")))
    return r.where(F.col("region_id") != F.col("neighbour_id")).distinct()


def replace_regions(base: DataFrame, other: DataFrame, countries: Sequence[str] | DataFrame,
                    country_col: str = "country") -> DataFrame:
    """U2 ``update_boundaries``: drop every region of the listed countries from
    ``base`` (even when ``other`` has none for that country) and append the
    listed countries' regions from ``other``. Columns are aligned by name;
    columns missing on one side become null. With a load position ``pos`` in
    ``base``, appended rows follow in the order of their own ``pos``, or of
    country and name where they have none."""
    if isinstance(countries, DataFrame):
        cl = countries.select(F.col(countries.columns[0]).alias(country_col)).distinct()
        kept = base.join(cl, country_col, "left_anti")
        new = other.join(cl, country_col, "left_semi")
    else:
        lst = list(dict.fromkeys(countries))
        kept = base.where(~F.col(country_col).isin(lst))
        new = other.where(F.col(country_col).isin(lst))
    if "pos" in base.columns:
        # appended rows come after every row of the base, in their own order;
        # the replacement set is a boundary list, so one order over it is small
        if "pos" not in new.columns:
            names = [x for x in (country_col, "name_en") if x in new.columns]
            new = new.withColumn("pos", F.row_number().over(Window.orderBy(*names)))
        new = new.withColumn("pos", base.select(F.max("pos")).scalar() + 1 + F.col("pos").cast("long"))
    return kept.unionByName(new, allowMissingColumns=True)


def merge_groups(regions: DataFrame, groups: DataFrame, country_col: str = "country",
                 name_col: str = "name_en", keep_children: bool = True, rings: str = "rings") -> DataFrame:
    """U3/U4 (``fix_france`` / ``fix_libya``): append one row per parent group
    (``groups``: country, child_name, parent_name) and either keep (France) or
    drop (Libya) the children.

    The parent has its own name only (other attributes are null), its
    children's rings, and a load position after all existing rows. Its rings
    keep the children's inner borders, so its neighbours are those of any
    child; parents and kept children overlap (see :func:`parent_pairs`).
    """
    g = groups.select(F.col("country").alias("_cc"), F.col("child_name").alias("_cn"), F.col("parent_name").alias("_pn"))
    of = (F.col(country_col) == F.col("_cc")) & (F.col(name_col) == F.col("_cn"))
    kids = regions.join(g, of)
    types = dict(regions.dtypes)
    order_col = "pos" if "pos" in regions.columns else None
    made = []
    for x in regions.columns:
        if x in (country_col, name_col):
            continue
        if x == rings:
            parts = F.struct(F.col(order_col) if order_col else F.col(name_col), F.col(rings).alias("r"))
            made.append(F.flatten(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["r"])).alias(x))
        else:
            made.append(F.lit(None).cast(types[x]).alias(x))
    parents = (kids.groupBy(F.col("_cc").alias(country_col), F.col("_pn").alias(name_col))
               .agg(*(made or [F.count(F.lit(1)).alias("_n")]))).select(*regions.columns)
    if order_col:
        # merged rows are appended after every existing row, ordered by
        # (country, parent name); the group table is small (one row per parent)
        rank = F.row_number().over(Window.orderBy(country_col, name_col))
        parents = parents.withColumn(order_col, (regions.select(F.max(order_col)).scalar() + rank).cast(types[order_col]))
    if keep_children:
        return regions.unionByName(parents)
    return regions.join(g, of, "left_anti").unionByName(parents)


def _groups(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "country string, child_name string, parent_name string")


def parent_pairs(spark) -> DataFrame:
    """(parent_id, child_id) of merged regions whose children are kept."""
    from . import fixed_values as FV
    g = _groups(spark, FV.group_rows(FV.FRANCE_REGIONS, "FRA"))
    name = lambda c: F.concat("country", F.lit(" - "), c)
    return g.select(name("parent_name").alias("parent_id"), name("child_name").alias("child_id")).distinct()


def prepare_boundaries(boundaries: DataFrame, second_set: DataFrame | None = None,
                       replaced: Sequence[str] | None = None, country_col: str = "country",
                       name_col: str = "name_en") -> DataFrame:
    """U3 + U4 + U2 as in the original preparation order: append the merged
    French regions (departments kept), replace Libyan districts by their three
    groups, then, with a second boundary set (``country, name_en`` [+ rings]),
    swap the listed countries for it."""
    from . import fixed_values as FV
    spark = boundaries.sparkSession
    b = merge_groups(boundaries, _groups(spark, FV.group_rows(FV.FRANCE_REGIONS, "FRA")), country_col, name_col, keep_children=True)
    b = merge_groups(b, _groups(spark, FV.group_rows(FV.LIBYA_REGIONS, "LBY")), country_col, name_col, keep_children=False)
    if second_set is None:
        return b
    return replace_regions(b, second_set, list(replaced if replaced is not None else FV.REPLACED_COUNTRIES), country_col)
