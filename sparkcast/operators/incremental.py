"""The panel kept up to date by arriving events.

``PanelStore`` holds, under one folder, the event counts by month and batch and
the panel's count and lag columns by month. A batch of events is aggregated once
and written as a batch of its own, so a repeated batch replaces itself and
nothing is read and overwritten at the same time. Then only the months the batch
touches are made again, and the ``lag`` months after each in the month axis,
whose lags look back at them: the counts read are those of these months and of
the months they look back to (partition pruning), not the history. A region that
no batch had before gets rows in all months, so then every month is made.

What depends on the whole table is added when it is read: the trend from the
month, the weight from the latest month. The edge table belongs to the store's
configuration; with other edges, types or lag use another folder.

Defined results: events without a region count for the month axis only; events
without a month are left out; an empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..cols import c, neighbour_name
from .panel import MONTH, REGION, add_lags, add_weights, trend_columns

MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class PanelStore:
    def __init__(self, spark: SparkSession, path: str, edges: DataFrame, type_col: str, types: Sequence[str], sub_col: str,
                 subtypes: Sequence[str] = (), lag: int = 1):
        self.spark, self.path, self.lag = spark, path.rstrip("/"), lag
        self.edges = edges.select(F.col("region_id").alias("_r"), F.col("neighbour_id").alias("_nb")).distinct()
        self.type_col, self.types, self.sub_col, self.subtypes = type_col, list(types), sub_col, list(subtypes)
        self.columns = self.types + self.subtypes + [neighbour_name(v) for v in self.types]

    def _stored(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{part}")
        except AnalysisException as e:      # nothing stored yet
            if e.getCondition() not in MISSING:
                raise
            return None

    def _write(self, df: DataFrame, part: str, *by: str) -> None:
        df.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{part}")

    def update(self, events: DataFrame, batch: int) -> dict:
        """Take in a batch of events (region_id, month, type and sub-type). Returns
        the months it touched and those made again, and the count rows read for it."""
        known = self._stored("regions")
        known = known.where(F.col("batch") != batch) if known is not None else None
        counts = (events.where(F.col(MONTH).isNotNull()).groupBy(REGION, MONTH, self.type_col, self.sub_col).agg(F.count(F.lit(1)).alias("n")))
        self._write(counts.withColumn("batch", F.lit(batch)), "counts", MONTH, "batch")
        stored = self._stored("counts")
        own = stored.where(F.col("batch") == batch) if stored is not None else None
        # the calendar bounds the months: lists of them fit the driver
        axis = sorted(r[0] for r in stored.select(MONTH).distinct().collect()) if stored is not None else []
        touched = sorted(r[0] for r in own.select(MONTH).distinct().collect()) if own is not None else []
        if not touched:
            return {"touched": [], "made": [], "rows_read": 0}
        regions = own.where(F.col(REGION).isNotNull()).select(REGION).distinct()
        new = regions if known is None else regions.join(known.select(REGION), REGION, "left_anti")
        grown = new.limit(1).count() > 0
        if grown:
            self._write(new.withColumn("batch", F.lit(batch)), "regions", "batch")
        at = {m: i for i, m in enumerate(axis)}
        made = set(axis) if grown else {axis[j] for m in touched for j in range(at[m], min(at[m] + self.lag + 1, len(axis)))}
        needed = sorted({axis[j] for m in made for j in range(max(0, at[m] - self.lag), at[m] + 1)})
        seen = Observation()
        rows = stored.where(F.col(MONTH).isin(needed)).observe(seen, F.count(F.lit(1)).alias("rows"))
        panel = self._panel(rows, needed).where(F.col(MONTH).isin(sorted(made)))
        self._write(panel, "panel", MONTH)
        return {"touched": touched, "made": sorted(made), "rows_read": seen.get["rows"]}

    def _panel(self, rows: DataFrame, months: list) -> DataFrame:
        """Count and lag columns of all regions in these months."""
        by = lambda col, values: [F.sum(F.when(F.col(col) == F.lit(v), F.col("n"))).cast("long").alias(v) for v in values]
        wide = rows.where(F.col(REGION).isNotNull()).groupBy(REGION, MONTH).agg(*by(self.type_col, self.types), *by(self.sub_col, self.subtypes))
        from ..session import materialize
        wide = materialize(wide)
        near = (wide.join(self.edges, F.col(REGION) == F.col("_nb")).groupBy(F.col("_r").alias(REGION), MONTH)
                .agg(*[F.sum(c(v)).cast("long").alias(neighbour_name(v)) for v in self.types]))
        grid = self._stored("regions").select(REGION).distinct().select(REGION, F.explode(F.array(*[F.lit(m) for m in months])).alias(MONTH))
        full = grid.join(wide, [REGION, MONTH], "left").join(near, [REGION, MONTH], "left")
        full = full.select(REGION, MONTH, *[F.coalesce(c(x), F.lit(0).cast("long")).alias(x) for x in self.columns])
        return add_lags(full, self.columns, self.lag)

    def read(self, decay: float = 0.05, base_year: int = 2018) -> DataFrame:
        """The panel as :func:`panel.build_panel` makes it from all events at once."""
        p = self._stored("panel")
        if p is None:
            raise ValueError(f"no panel is stored under {self.path}")
        latest = self._stored("counts").select(F.max(MONTH)).scalar()
        return add_weights(p.select("*", *trend_columns(MONTH, base_year)), decay, latest=latest)
