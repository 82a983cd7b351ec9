"""Registered panel / evaluation / model queries over the stand-in events."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from ..cols import c, lag_name, neighbour_name
from ..operators import forecast, panel, region_forests as RF
from ..operators.incremental import PanelStore
from ..session import scratch_path
from ..sources.sinks import write_panel
from . import standins as S

ROUND = 9   # doubles are reported rounded to 9 decimals (same on the SQL side)


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = S.events(spark, sf_dir)
    return panel.build_panel(ev, S.nation_edges(spark, sf_dir), "event_type", S.EVENT_TYPES,
                             "sub_event_type", S.SUB_EVENT_TYPES, lag=S.LAG, decay=S.DECAY,
                             base_year=S.START_YEAR)


def predictors() -> list[str]:
    return panel.predictor_names(S.EVENT_TYPES, S.SUB_EVENT_TYPES, S.LAG)


def monthly_event_panel(spark, sf_dir):
    return panel.monthly_counts(S.events(spark, sf_dir), "event_type", S.EVENT_TYPES)


def monthly_subevent_panel(spark, sf_dir):
    return panel.monthly_counts(S.events(spark, sf_dir), "sub_event_type", S.SUB_EVENT_TYPES)


def neighbour_event_sums(spark, sf_dir):
    counts = panel.aggregate_events(S.events(spark, sf_dir), ["region_id", "month", "event_type"])
    return panel.neighbour_sums(counts, S.nation_edges(spark, sf_dir), "event_type", S.EVENT_TYPES)


def _count_cols() -> list[str]:
    return S.EVENT_TYPES + S.SUB_EVENT_TYPES + [neighbour_name(v) for v in S.EVENT_TYPES]


def lagged_panel(spark, sf_dir):
    cols = _count_cols()
    p = _panel(spark, sf_dir)
    return p.select("region_id", "month", *[c(x) for x in cols],
                    *[c(lag_name(x, S.LAG)) for x in cols])


def trend_features(spark, sf_dir):
    p = _panel(spark, sf_dir)
    names = ["linear_month_trend", "year"] + [f"month_{k}" for k in panel.MONTH_LEVELS] + \
            [f"quarter_{k}" for k in panel.QUARTER_LEVELS]
    return p.select("region_id", "month", *names)


def importance_weights(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return p.select("region_id", "month", F.round("importance_weight", ROUND).alias("importance_weight"))


def model_table(spark, sf_dir):
    m = panel.model_table(_panel(spark, sf_dir), predictors(), S.TARGETS)
    return m.withColumn("importance_weight", F.round("importance_weight", ROUND))


def holdout_split(spark, sf_dir):
    p = forecast.split_holdout(_panel(spark, sf_dir), S.HOLDOUT)
    return p.select("region_id", "month", "split", "step")


def persistence_eval(spark, sf_dir):
    e = forecast.persistence_eval(_panel(spark, sf_dir), S.TARGETS, S.HOLDOUT, lag=S.LAG)
    return e.select("region_id", "target", F.round("mae", ROUND).alias("mae"),
                    F.round("mape", ROUND).alias("mape"), "n_test")


def _fit(spark, sf_dir, num_trees=100, max_depth=10):
    return forecast.fit_pooled(_panel(spark, sf_dir), predictors(), S.TARGETS, S.HOLDOUT,
                               num_trees=num_trees, max_depth=max_depth)


def rf_forecast(spark, sf_dir):
    return _fit(spark, sf_dir)[0]


def rf_importance(spark, sf_dir):
    return _fit(spark, sf_dir)[1]


def rf_weighted_mean(spark, sf_dir):
    """The forest of one tree without a split and without bootstrap: it
    predicts the weighted mean of the training labels, which SQL can check."""
    p = forecast.fit_pooled(_panel(spark, sf_dir), predictors(), S.TARGETS, S.HOLDOUT,
                            num_trees=1, max_depth=0, bootstrap=False)[0]
    return p.select("region_id", "month", "target", "step", "actual", F.round("predicted", 6).alias("predicted"))


def region_tree(spark, sf_dir):
    """One tree a region and target, depth 2, without bootstrap: SQL can check it."""
    g = RF.grow(_panel(spark, sf_dir), predictors(), S.TARGETS, S.HOLDOUT, num_trees=1, max_depth=2, bootstrap=False)
    return RF.predictions(g).withColumn("predicted", F.round("predicted", 6))


def region_forest_eval(spark, sf_dir):
    """MAE and MAPE of every region's own forests on its last months."""
    g = RF.grow(_panel(spark, sf_dir), predictors(), S.TARGETS, S.HOLDOUT, num_trees=20, max_depth=3)
    return forecast.error_metrics(RF.predictions(g), ["region_id", "target"])


def incremental_panel(spark, sf_dir):
    """The panel from a base and three increments: two later years, then the
    events of one status, which come late for all months."""
    import uuid
    ev = S.events(spark, sf_dir)
    late, year = F.coalesce(F.col("sub_event_type") == "P", F.lit(False)), F.year("month")
    store = PanelStore(spark, scratch_path(spark, f"panel_store/{uuid.uuid4().hex}"), S.nation_edges(spark, sf_dir),
                       "event_type", S.EVENT_TYPES, "sub_event_type", S.SUB_EVENT_TYPES, S.LAG)
    for k, part in enumerate((~late & (year < 2000), ~late & (year == 2000), ~late & (year > 2000), late)):
        store.update(ev.where(part), k)
    cols = _count_cols()
    return store.read(S.DECAY, S.START_YEAR).select("region_id", "month", *[c(x) for x in cols], *[c(lag_name(x, S.LAG)) for x in cols])


BUCKETS = 32    # of the stored panel


def stored_panel(spark, sf_dir):
    """The monthly panel stored by region (K1); lags and holdout read it in place."""
    import uuid
    name = f"panel_{uuid.uuid4().hex}"
    p = write_panel(monthly_event_panel(spark, sf_dir), name, scratch_path(spark, f"stored_panel/{name}"), BUCKETS)
    out = forecast.split_holdout(panel.add_lags(p, S.EVENT_TYPES, S.LAG), S.HOLDOUT)
    return out.select("region_id", "month", *[c(x) for x in S.EVENT_TYPES], *[c(lag_name(x, S.LAG)) for x in S.EVENT_TYPES], "split", "step")


QUERIES = {
    "stored_panel": stored_panel,
    "incremental_panel": incremental_panel,
    "region_tree": region_tree,
    "region_forest_eval": region_forest_eval,
    "monthly_event_panel": monthly_event_panel,
    "monthly_subevent_panel": monthly_subevent_panel,
    "neighbour_event_sums": neighbour_event_sums,
    "lagged_panel": lagged_panel,
    "trend_features": trend_features,
    "importance_weights": importance_weights,
    "model_table": model_table,
    "holdout_split": holdout_split,
    "persistence_eval": persistence_eval,
    "rf_forecast": rf_forecast,
    "rf_importance": rf_importance,
    "rf_weighted_mean": rf_weighted_mean,
}
