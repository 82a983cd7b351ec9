"""Holdout, evaluation and random-forest forecasting.

The panel is aggregated (regions x months rows), so it is small next to the
raw events even at 100 TB of input. The reference fits one scikit-learn
forest per (region, target) in a CLI loop; here:

* ``fit_region`` keeps that meaning (one region, one target);
* ``fit_pooled`` is the at-scale path (M6): one distributed Spark ML forest
  per target over all regions -- a stated change of meaning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..cols import c, lag_name
from .panel import MONTH, REGION


def split_holdout(df: DataFrame, n: int = 6, region: str = REGION, month: str = MONTH) -> DataFrame:
    """The last ``n`` months of each region are ``test``, the rest ``train``
    (``step`` = 1..n counts the test months in time order)."""
    w = Window.partitionBy(region).orderBy(F.col(month).desc())
    rn = F.row_number().over(w)
    return (df.withColumn("_rn", rn)
            .withColumn("split", F.when(F.col("_rn") <= n, F.lit("test")).otherwise(F.lit("train")))
            .withColumn("step", F.when(F.col("_rn") <= n, F.lit(n + 1) - F.col("_rn")))
            .drop("_rn"))


def error_metrics(pred: DataFrame, keys: Sequence[str], actual: str = "actual",
                  predicted: str = "predicted") -> DataFrame:
    """MAE and MAPE (percent, over non-zero actuals; null when every
    actual is zero -- the reference gives NaN) per key."""
    y, yh = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return pred.groupBy(*keys).agg(
        F.avg(F.abs(y - yh)).alias("mae"),
        (F.avg(F.when(y != 0, F.abs((y - yh) / y))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n_test"))


def long_targets(df: DataFrame, targets: Sequence[str], region: str = REGION,
                 month: str = MONTH, lag: int = 1) -> DataFrame:
    """Unpivot targets and their lag columns to (region, month, target, actual, lagged)."""
    pairs = ", ".join(f"'{t}', `{t}`, `{lag_name(t, lag)}`" for t in targets)
    return df.select(region, month, "split", "step",
                     F.expr(f"stack({len(targets)}, {pairs}) AS (target, actual, lagged)"))


def persistence_eval(panel: DataFrame, targets: Sequence[str], n: int = 6,
                     region: str = REGION, month: str = MONTH, lag: int = 1) -> DataFrame:
    """M4 with the persistence forecast (prediction = the lag-1 value): MAE and
    MAPE per (region, target) on each region's last ``n`` months."""
    h = split_holdout(panel, n, region, month).where(F.col("split") == "test")
    lt = long_targets(h, targets, region, month, lag)
    return error_metrics(lt.withColumnRenamed("lagged", "predicted"), [region, "target"])


def _assembler(predictors: Sequence[str]):
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(predictors), outputCol="features", handleInvalid="error")


def _forest(target: str, num_trees: int, max_depth: int, seed: int, weight: str | None,
            max_bins: int = 32, bootstrap: bool = True):
    from pyspark.ml.regression import RandomForestRegressor
    kw = dict(featuresCol="features", labelCol=target, predictionCol="predicted",
              numTrees=num_trees, maxDepth=max_depth, seed=seed,
              featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=bootstrap, maxBins=max_bins,
              maxMemoryInMB=1024, cacheNodeIds=True)
    if weight:
        kw["weightCol"] = weight
    return RandomForestRegressor(**kw)


def _train_rows(h: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Training rows: the ``train`` split minus the lag warm-up rows (Q4)."""
    cond = F.lit(True)
    for p in predictors:
        cond = cond & c(p).isNotNull()
    return h.where((F.col("split") == "train") & cond)


def fit_pooled(panel: DataFrame, predictors: Sequence[str], targets: Sequence[str],
               n: int = 6, num_trees: int = 100, max_depth: int = 10, seed: int = 42,
               weight: str | None = "importance_weight",
               region: str = REGION, month: str = MONTH, max_bins: int = 32, bootstrap: bool = True):
    """M6: one forest per target over all regions' training rows.

    Returns ``(predictions, importances)``: predictions ``(region, month,
    target, step, actual, predicted)`` for every region's test months and
    importances ``(target, feature, importance)``. Spark ML's forest is not
    bit-identical to scikit-learn's (``max_bins`` split points per feature;
    ``max_depth`` up to Spark ML's limit of 30, more is an error).
    """
    if max_depth > 30:
        raise ValueError(f"max_depth is {max_depth}; Spark ML grows trees to a depth of 30")
    from concurrent.futures import ThreadPoolExecutor

    spark = panel.sparkSession
    # Q10: a region needs more than n rows for a holdout; others are skipped
    # (see ``short_regions``)
    enough = panel.groupBy(region).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > n)
    # the split panel is small (regions x months): write it once and cut its
    # lineage; train and test both read it, train is cached for the many
    # passes of the tree growth
    from ..session import materialize
    h = materialize(split_holdout(panel.join(enough.select(region), region, "left_semi"), n, region, month))
    asm = _assembler(predictors)
    train = asm.transform(_train_rows(h, predictors)).cache()
    if train.limit(1).count() == 0:
        train.unpersist()
        raise ValueError(f"no training rows: no region has more than {n} rows with all predictors set")
    test = asm.transform(h.where(F.col("split") == "test"))

    def fit_one(t):
        return _forest(t, num_trees, max_depth, seed, weight, max_bins, bootstrap).fit(train)

    # one forest per target; the fits are independent Spark jobs, so they
    # are submitted concurrently and share the cluster
    try:
        with ThreadPoolExecutor(max_workers=max(1, len(targets))) as pool:
            models = list(pool.map(fit_one, targets))
    finally:
        train.unpersist()
    preds, imps = [], []
    for t, model in zip(targets, models):
        p = model.transform(test).select(region, month, F.lit(t).alias("target"), "step",
                                         c(t).cast("double").alias("actual"), "predicted")
        preds.append(p)
        imp = model.featureImportances.toArray().tolist()
        imps.append(spark.createDataFrame(
            [(t, f, float(v)) for f, v in zip(predictors, imp)],
            "target string, feature string, importance double"))
    out_p = preds[0]
    for p in preds[1:]:
        out_p = out_p.unionByName(p)
    out_i = imps[0]
    for i in imps[1:]:
        out_i = out_i.unionByName(i)
    return out_p, out_i.orderBy("target", "importance")


def short_regions(panel: DataFrame, n: int = 6, region: str = REGION) -> DataFrame:
    """Q10 report: regions with too few rows for an ``n``-month holdout."""
    return (panel.groupBy(region).agg(F.count(F.lit(1)).alias("rows"))
            .where(F.col("rows") <= n))


def fit_region(panel: DataFrame, region_value, target: str, predictors: Sequence[str],
               n: int = 6, num_trees: int = 100, max_depth: int = 30, seed: int = 42,
               region: str = REGION, month: str = MONTH, max_bins: int = 32):
    """M1-M5 for one region and one target (the reference's CLI call).

    Raises when the region has no rows or too few for a holdout (Q10).
    Returns ``(predictions, metrics, importances)``.
    """
    one = panel.where(F.col(region) == F.lit(region_value))
    n_rows = one.count()
    if n_rows == 0:
        raise KeyError(f"region {region_value!r} not in the panel")
    if n_rows <= n:
        raise ValueError(f"region {region_value!r} has {n_rows} rows; need more than {n}")
    p, i = fit_pooled(one, predictors, [target], n, num_trees, max_depth, seed,
                      region=region, month=month, max_bins=max_bins)
    return p, error_metrics(p, [region, "target"]), i


def forecast(panel: DataFrame, region_value, target: str, predictors: Sequence[str], n: int = 6,
             region: str = REGION, month: str = MONTH):
    """M5 ``forecast_admin1_events``: P4 -> W3 -> M1 -> M2 -> A11/A12 for one
    region and one target on a (stored or rebuilt, see ``load_or_build``)
    panel. Returns ``(predictions, metrics, importances)``."""
    return fit_region(panel, region_value, target, predictors, n, region=region, month=month)
