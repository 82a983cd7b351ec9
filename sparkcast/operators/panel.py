"""Region x month panel.

The reference builds the panel with pandas reindex/unstack and Python loops
over every (region, month). Here every step is a DataFrame transformation:

* counts are aggregated once per (region, month, type) -- map-side partial
  aggregation collapses hot regions before the shuffle;
* the month axis is a bounded array (distinct calendar months, hundreds at
  most) computed by a scalar subquery and exploded per region, so the dense
  grid needs neither a cross join nor a driver round trip;
* type columns come from a closed value list (no extra job for pivot values);
* neighbour sums join the small aggregated counts with the edge table, never
  raw events;
* lags and holdout flags use windows partitioned by region (one row per
  month, so a window partition is bounded by the month count).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cols import c, lag_name, neighbour_name

REGION = "region_id"
MONTH = "month"


def month_of(col: Column | str, fmt: str | None = None) -> Column:
    """First day of the month of a date, timestamp or formatted string.

    ``fmt`` is the Spark datetime pattern for string input; the reference's
    ``%d %B %Y`` is ``d MMMM yyyy``. Unparseable strings give null.
    """
    col = F.col(col) if isinstance(col, str) else col
    d = F.try_to_timestamp(col, F.lit(fmt)) if fmt else col
    return F.trunc(F.to_date(d), "month")


def event_counts(events: DataFrame, type_col: str, region: str = REGION,
                 month: str = MONTH) -> DataFrame:
    """A1: events per (region, month, type), long form, column ``n``.

    Rows with a null region are kept: their months still belong to the month
    axis (Q3); they are dropped where the panel is built.
    """
    return events.groupBy(region, month, type_col).agg(F.count(F.lit(1)).alias("n"))


def aggregate_events(events: DataFrame, keys: Sequence[str], materialize: bool = True,
                     weight: str | None = None) -> DataFrame:
    """One pass over the raw events: counts per ``keys`` (partial aggregation
    before the shuffle). Every panel table derives from this small result.

    With ``materialize`` the aggregate is written once to the shared
    checkpoint folder: the raw scan runs once even though several branches
    (month axis, grid, pivots, neighbour sums) read it, and a lost executor
    later does not send the job back to the raw events.
    """
    n = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    base = events.groupBy(*keys).agg(n.alias("n"))
    if materialize:
        from ..session import materialize as write_and_read
        base = write_and_read(base)
    return base


def month_axis(counts: DataFrame, month: str = MONTH) -> Column:
    """Sorted distinct months of all rows, as one array-valued scalar subquery."""
    return counts.select(F.array_sort(F.collect_set(month))).scalar()


def region_month_grid(counts: DataFrame, region: str = REGION,
                      month: str = MONTH) -> DataFrame:
    """Every matched region x every observed month.

    Regions come from rows with a non-null region; months from all rows (Q2,
    Q3). The month array is bounded by the calendar span of the data.
    """
    months = month_axis(counts, month)
    return (counts.where(F.col(region).isNotNull()).select(region).distinct()
            .select(region, F.explode(months).alias(month)))


def pivot_counts(counts: DataFrame, type_col: str, values: Sequence[str],
                 region: str = REGION, month: str = MONTH,
                 suffix: str = "") -> DataFrame:
    """A3/A4: long counts -> one count column per listed value (closed pivot)."""
    aggs = [F.sum(F.when(F.col(type_col) == F.lit(v), F.col("n"))).cast("long")
            .alias(f"{v}{suffix}") for v in values]
    return (counts.where(F.col(region).isNotNull())
            .groupBy(region, month).agg(*aggs))


def zero_fill(grid: DataFrame, wide: DataFrame, cols: Sequence[str],
              region: str = REGION, month: str = MONTH) -> DataFrame:
    """A2: left join a wide count table to the grid, missing cells -> 0."""
    j = grid.join(wide, [region, month], "left")
    return j.select(region, month,
                    *[F.coalesce(c(x), F.lit(0).cast("long")).alias(x) for x in cols])


def check_values(counts: DataFrame, type_col: str, values: Sequence[str]) -> None:
    """``strict`` mode of A4 (Q18): fail on a listed value absent from the data."""
    present = {r[0] for r in counts.where(F.col(type_col).isin(list(values)))
               .select(type_col).distinct().collect()}
    missing = [v for v in values if v not in present]
    if missing:
        raise KeyError(f"values not in the data: {missing}")


def present_values(counts: DataFrame, col: str) -> list[str]:
    """Sorted distinct values of ``col`` in an aggregated table (a bounded
    vocabulary such as event types)."""
    return [r[0] for r in counts.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).collect()]


def monthly_counts(events: DataFrame, type_col: str, values: Sequence[str],
                   region: str = REGION, month: str = MONTH,
                   strict: bool = False) -> DataFrame:
    """A3/A4 ``get_monthly_events`` / ``get_monthly_subevents``.

    Dense (region, month) panel with one zero-filled count column per value.
    """
    counts = aggregate_events(events, [region, month, type_col])
    if not values:                       # P5: an empty list means every value
        values = present_values(counts, type_col)
    if strict:
        check_values(counts, type_col, values)
    grid = region_month_grid(counts, region, month)
    return zero_fill(grid, pivot_counts(counts, type_col, values, region, month),
                     list(values), region, month)


def neighbour_sums(counts: DataFrame, edges: DataFrame, type_col: str,
                   values: Sequence[str], grid: DataFrame | None = None,
                   region: str = REGION, month: str = MONTH) -> DataFrame:
    """A5/J10 ``summarise_neighbour_events``: per (region, month) the sum of
    each type's count over the region's neighbours, 0 when none.

    ``edges`` has columns ``region_id, neighbour_id`` (distinct, no self
    edges). Counts are aggregated before the join, so the join input is
    (regions x months x types) rows, not events.
    """
    if grid is None:
        grid = region_month_grid(counts, region, month)
    e = edges.select(F.col("region_id").alias("_r"), F.col("neighbour_id").alias("_nb")).distinct()
    nb = (counts.where(F.col(region).isNotNull())
          .join(e, F.col(region) == F.col("_nb"))
          .select(F.col("_r").alias(region), month, type_col, "n"))
    names = [neighbour_name(v) for v in values]
    wide = pivot_counts(nb, type_col, values, region, month, suffix="_neighbours")
    return zero_fill(grid, wide, names, region, month)


def add_lags(df: DataFrame, cols: Sequence[str], lag: int = 1,
             region: str = REGION, month: str = MONTH) -> DataFrame:
    """W1 ``add_lagged_columns``: ``X (t-lag)`` = X of the previous ``lag``-th
    row of the same region in month order; the first ``lag`` rows are null."""
    w = Window.partitionBy(region).orderBy(month)
    return df.select("*", *[F.lag(c(x), lag).over(w).alias(lag_name(x, lag)) for x in cols])


MONTH_LEVELS = list(range(2, 13))
QUARTER_LEVELS = [2, 3, 4]


def trend_columns(month: str = MONTH, base_year: int = 2018, base_month: int = 1) -> list[Column]:
    """linear month trend (base month = 0), year, one-hot month 2-12
    and quarter 2-4 (fixed levels, Q9)."""
    m = F.col(month)
    cols = [((F.year(m) - base_year) * 12 + (F.month(m) - base_month)).alias("linear_month_trend"),
            F.year(m).alias("year")]
    cols += [(F.month(m) == k).cast("int").alias(f"month_{k}") for k in MONTH_LEVELS]
    cols += [(F.quarter(m) == k).cast("int").alias(f"quarter_{k}") for k in QUARTER_LEVELS]
    return cols


def add_trend(df: DataFrame, month: str = MONTH, base_year: int = 2018,
              base_month: int = 1) -> DataFrame:
    """F21 ``add_time_trend_features``."""
    return df.select("*", *trend_columns(month, base_year, base_month))


def months_between_firsts(later: Column, earlier: Column) -> Column:
    """F8: whole calendar months from ``earlier`` to ``later`` (exact integers)."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def add_weights(df: DataFrame, decay: float = 0.05, month: str = MONTH,
                latest: Column | None = None) -> DataFrame:
    """W2 ``add_importance_weights``: exp(-decay * months since the latest month
    of the whole table). The latest month is a scalar subquery (one row),
    not a global window."""
    if latest is None:
        latest = df.select(F.max(month)).scalar()
    return df.withColumn("importance_weight",
                         F.exp(F.lit(-float(decay)) * months_between_firsts(latest, F.col(month))))


def build_panel(events: DataFrame, edges: DataFrame, type_col: str, types: Sequence[str],
                sub_col: str | None = None, subtypes: Sequence[str] = (),
                lag: int = 1, decay: float = 0.05, base_year: int = 2018,
                region: str = REGION, month: str = MONTH, weight: str | None = None) -> DataFrame:
    """M7 ``prepare_data_pipeline`` after matching: event counts || sub-event
    counts, left join neighbour sums (J12), lags of every count column (W1),
    trend features (F21) and recency weights (W2) in one lazy plan.

    ``events`` needs ``region_id`` (null = unmatched), ``month`` (first of
    month) and the two type columns; ``weight`` names a column holding how
    many events a row stands for (pre-aggregated input), else rows count 1.
    """
    # One pass over the events: every later table derives from this small
    # (region, month, type[, sub-type]) aggregate, written once.
    has_sub = sub_col is not None
    keys = [region, month, type_col] + ([sub_col] if has_sub else [])
    base = aggregate_events(events, keys, weight=weight)
    if has_sub and not subtypes:         # P5: an empty list means every sub-type
        subtypes = present_values(base, sub_col)
    months = month_axis(base, month)
    # every count column of the panel from one aggregation of the base
    aggs = [F.sum(F.when(F.col(type_col) == F.lit(v), F.col("n"))).cast("long").alias(v) for v in types]
    if has_sub:
        aggs += [F.sum(F.when(F.col(sub_col) == F.lit(v), F.col("n"))).cast("long").alias(v) for v in subtypes]
    wide = base.where(F.col(region).isNotNull()).groupBy(region, month).agg(*aggs)
    grid = wide.select(region).distinct().select(region, F.explode(months).alias(month))
    # neighbour sums: the (region, month) counts joined to the edge table
    nb_names = [neighbour_name(v) for v in types]
    e = edges.select(F.col("region_id").alias("_r"), F.col("neighbour_id").alias("_nb")).distinct()
    nb_wide = (wide.join(e, F.col(region) == F.col("_nb"))
               .groupBy(F.col("_r").alias(region), month)
               .agg(*[F.sum(c(v)).cast("long").alias(nm) for v, nm in zip(types, nb_names)]))
    count_cols = list(types) + (list(subtypes) if has_sub else []) + nb_names
    j = grid.join(wide, [region, month], "left").join(nb_wide, [region, month], "left")
    panel = j.select(region, month,
                     *[F.coalesce(c(x), F.lit(0).cast("long")).alias(x) for x in count_cols])
    panel = add_lags(panel, count_cols, lag, region, month)
    panel = panel.select("*", *trend_columns(month, base_year))
    return add_weights(panel, decay, month, latest=F.array_max(months))


def predictor_names(types: Sequence[str], subtypes: Sequence[str] = (), lag: int = 1) -> list[str]:
    """The model's predictor list in the reference's order: lagged type counts,
    lagged sub-type counts, lagged neighbour sums, trend, year, month and
    quarter dummies, weight (Q8: the weight is also a predictor)."""
    names = [lag_name(v, lag) for v in types]
    names += [lag_name(v, lag) for v in subtypes]
    names += [lag_name(neighbour_name(v), lag) for v in types]
    names += ["linear_month_trend", "year"]
    names += [f"month_{k}" for k in MONTH_LEVELS] + [f"quarter_{k}" for k in QUARTER_LEVELS]
    names += ["importance_weight"]
    return names


def model_table(panel: DataFrame, predictors: Sequence[str], targets: Sequence[str],
                region: str = REGION, month: str = MONTH) -> DataFrame:
    """Keep the key, predictors and targets; a missing column fails."""
    missing = [x for x in list(predictors) + list(targets) if x not in panel.columns]
    if missing:
        raise KeyError(f"columns not in the panel: {missing}")
    keep = [region, month] + [x for x in predictors] + [t for t in targets if t not in predictors]
    return panel.select(*[c(x) for x in keep])


def filter_region(df: DataFrame, region_value, region: str = REGION) -> DataFrame:
    """P4 ``filter_admin1_data``: rows of one region (lazy; an empty result is
    reported by the caller that needs rows, as the model fit does)."""
    return df.where(F.col(region) == F.lit(region_value))
