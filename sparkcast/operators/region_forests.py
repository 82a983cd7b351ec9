"""One forest a region and target (M1-M3, M6), all regions at once.

Trees grow level by level as window functions over (region, target, tree): the
rows of a node are sorted by each feature, running sums of weight and weighted
label tell how much every threshold reduces the weighted squared error, and the
best one sends the rows on. All windows are partitioned by at least (region,
target, tree), so the rows are shuffled once and stay where they are for the
whole forest: no exchange a level, no driver loop over regions, and no group is
larger than the months of a region. The rows to predict go through the trees
with weight 0, so no model is collected and none is joined.

As in the usual forests, thresholds lie half-way between neighbouring training
values and rows up to a threshold go left; reductions are compared relative to
the node's error at ``DIGITS`` decimals, ties go to the first feature and the
least threshold. Bootstrap: each training row counts Poisson(1) times in each tree,
drawn from a hash of region, month, tree and seed, so retried tasks draw the same.

Regions without more than ``n`` rows, or without a training row with all
predictors, have no forest (Q10). Nulls in a predictor: not a training row; a test
row with a null goes left. Null labels and weights: not a training row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..cols import c
from .forecast import split_holdout
from .panel import MONTH, REGION

DIGITS = 9
# fixed values: the share of draws of a Poisson variable of mean 1 up to 0, 1, 2 ...
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def _rows(panel: DataFrame, predictors: Sequence[str], targets: Sequence[str], n: int, trees: int, weight: str | None,
          bootstrap: bool, seed: int, region: str, month: str) -> DataFrame:
    h = split_holdout(panel, n, region, month)
    x = F.array(*[c(p).cast("double") for p in predictors])
    stack = F.array(*[F.struct(F.lit(t).alias("target"), c(t).cast("double").alias("y")) for t in targets])
    rows = h.select(F.col(region).alias("region"), F.col(month).alias("month"), "split", "step", x.alias("x"),
                    (c(weight).cast("double") if weight else F.lit(1.0)).alias("w0"), F.explode(stack).alias("t"))
    rows = rows.select("region", "month", F.col("t.target").alias("target"), "split", "step", F.col("t.y").alias("y"), "w0", "x",
                       F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
    full = ~F.exists("x", lambda v: v.isNull()) & F.col("y").isNotNull() & F.col("w0").isNotNull()
    u = F.pmod(F.xxhash64("region", F.col("month").cast("string"), "tree", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    times = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0)) if bootstrap else F.lit(1)
    rows = rows.withColumn("w", F.when(F.col("split") == "test", 0.0).when(full, F.col("w0") * times).otherwise(0.0))
    rows = rows.where((F.col("split") == "test") | (F.col("w") > 0)).drop("w0")
    return rows.repartition("region", "target", "tree").withColumns({"node": F.lit(1).cast("long"), "path": F.expr("cast(array() as array<struct<f: int, d: double>>)")})


def _level(rows: DataFrame) -> DataFrame:
    """Every node's rows on to its children, where its best threshold reduces the error."""
    node = ["region", "target", "tree", "node"]
    e = rows.select("*", F.posexplode("x").alias("f", "v"))
    all_, upto, at = Window.partitionBy(*node, "f"), Window.partitionBy(*node, "f").orderBy("v"), Window.partitionBy(*node)
    wy = F.col("w") * F.coalesce("y", F.lit(0.0))
    e = e.withColumns({"ww": F.sum("w").over(all_), "s": F.sum(wy).over(all_), "q": F.sum(wy * F.coalesce("y", F.lit(0.0))).over(all_),
                       "wl": F.sum("w").over(upto), "sl": F.sum(wy).over(upto),
                       "next": F.expr("lead(CASE WHEN w > 0 THEN v END) IGNORE NULLS OVER (PARTITION BY region, target, tree, node, f ORDER BY v)")})
    err = F.expr("q - s * s / ww")
    drop = F.expr("sl * sl / wl + (s - sl) * (s - sl) / (ww - wl) - s * s / ww")
    may = F.expr("w > 0 AND next > v AND ww > wl AND wl > 0") & (err > 1e-9)
    gain = F.when(may, F.round(drop / err, DIGITS))
    split = F.when(gain > 0, F.struct(gain.alias("gain"), (-F.col("f")).alias("nf"), (-(F.col("v") + F.col("next")) / 2).alias("nt"),
                                      (drop / F.col("ww")).alias("each")))
    e = e.withColumn("best", F.max(split).over(at)).where(F.col("f") == -F.coalesce("best.nf", F.lit(0)))
    right = F.coalesce(F.col("v") > -F.col("best.nt"), F.lit(False)).cast("long")
    # a split's reduction is shared out among its rows by weight, to be added up later
    step = F.struct(F.col("f").cast("int").alias("f"), (F.col("best.each") * F.col("w")).alias("d"))
    return e.select(*[x for x in rows.columns if x not in ("node", "path")],
                    F.when(F.col("best").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right).alias("node"),
                    F.when(F.col("best").isNull() | (F.col("w") <= 0), F.col("path")).otherwise(F.concat("path", F.array(step))).alias("path"))


def grow(panel: DataFrame, predictors: Sequence[str], targets: Sequence[str], n: int = 6, num_trees: int = 100, max_depth: int = 5,
         seed: int = 42, weight: str | None = "importance_weight", bootstrap: bool = True, region: str = REGION, month: str = MONTH) -> DataFrame:
    """All trees of all regions and targets: one row for each (region, target,
    tree, month) with the row's last node, its path and, for rows to predict, the
    tree's prediction (weighted mean of the node's training labels)."""
    rows = _rows(panel, predictors, targets, n, num_trees, weight, bootstrap, seed, region, month)
    for _ in range(max_depth):
        rows = _level(rows)
    leaf = Window.partitionBy("region", "target", "tree", "node")
    return rows.withColumn("predicted", F.try_divide(F.sum(F.col("w") * F.coalesce("y", F.lit(0.0))).over(leaf), F.sum("w").over(leaf))).drop("x")


def predictions(grown: DataFrame) -> DataFrame:
    """(region_id, month, target, step, actual, predicted): mean over the trees."""
    return (grown.where("split = 'test'").groupBy("region", "month", "target", "step").agg(F.first("y").alias("actual"), F.avg("predicted").alias("predicted"))
            .where("predicted IS NOT NULL").withColumnRenamed("region", REGION))


def importances(grown: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """(region_id, target, feature, importance): share of the error's reduction,
    per tree, then averaged over the trees that split; adds up to 1."""
    names = F.array(*[F.lit(p) for p in predictors])
    one = grown.where("w > 0").select("region", "target", "tree", F.explode("path").alias("p")).groupBy("region", "target", "tree", F.col("p.f").alias("f")).agg(F.sum("p.d").alias("d"))
    share = one.withColumn("share", F.col("d") / F.sum("d").over(Window.partitionBy("region", "target", "tree")))
    total = share.groupBy("region", "target", "f").agg(F.sum("share").alias("s"))
    return (total.withColumn("importance", F.col("s") / F.sum("s").over(Window.partitionBy("region", "target")))
            .select(F.col("region").alias(REGION), "target", F.try_element_at(names, F.col("f") + 1).alias("feature"), "importance"))


def fit_regions(panel: DataFrame, predictors: Sequence[str], targets: Sequence[str], **how) -> tuple[DataFrame, DataFrame]:
    """(predictions, importances) of one forest for every region and target; the
    grown trees are written once and read by both."""
    from ..session import materialize
    grown = materialize(grow(panel, predictors, targets, **how))
    return predictions(grown), importances(grown, predictors)
