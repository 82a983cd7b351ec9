"""Sinks (K1-K5). Every sink writes in parallel from the executors; nothing
is gathered on the driver."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..cols import c
from ..operators.panel import MONTH, REGION


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K1: the model table (Parquet by default; ``fmt='csv'`` adds a header)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def write_panel(df: DataFrame, table: str, path: str, buckets: int, region: str = REGION, month: str = MONTH) -> DataFrame:
    """K1 with a layout: a table at ``path`` in ``buckets`` files by region (one
    shuffle, one file a bucket), each sorted by region and month. Lags and holdout
    over it need no exchange, one region reads one file. Regions without an id share
    a bucket. Returns the table as read."""
    (df.repartition(buckets, c(region)).write.mode("overwrite").format("parquet").bucketBy(buckets, region).sortBy(region, month)
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def open_panel(spark: SparkSession, table: str, path: str, buckets: int, region: str = REGION, month: str = MONTH) -> DataFrame:
    """A panel that another session has written, under its layout (``buckets`` as
    written; files that don't fit it are an error when they are read)."""
    schema = spark.read.parquet(path).schema.toDDL()
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{table}` ({schema}) USING parquet CLUSTERED BY (`{region}`) SORTED BY (`{region}`, `{month}`) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def write_indicators(long: DataFrame, wide: DataFrame | None, out_dir: str) -> None:
    """K2: one CSV folder per indicator (partitioned by indicator name) and
    the combined wide table when more than one indicator is present."""
    (long.write.mode("overwrite").option("header", True)
     .partitionBy("indicator_name").csv(f"{out_dir}/by_indicator"))
    if wide is not None:
        wide.write.mode("overwrite").option("header", True).csv(f"{out_dir}/combined_indicators")


def write_articles(df: DataFrame, path: str) -> None:
    """K3: articles as UTF-8 JSON lines (non-ASCII kept)."""
    df.write.mode("overwrite").option("encoding", "UTF-8").json(path)


def write_metric_matrices(wide: DataFrame, out_dir: str, run_ts: str | None = None) -> str:
    """K4: one CSV per metric (folder ``metric=<name with _>``) under a run
    time stamp. ``wide`` comes from :func:`pages.matrix_wide`."""
    run_ts = run_ts or datetime.now(timezone.utc).strftime("%Y-%m-%d_%H-%M-%S")
    out = f"{out_dir}/run_ts={run_ts}"
    (wide.withColumn("metric", F.replace(F.col("metric"), F.lit(" "), F.lit("_")))
     .write.mode("overwrite").option("header", True).partitionBy("metric").csv(out))
    return out


def write_news_table(df: DataFrame, path: str) -> None:
    """K5: the flat news table as UTF-8 CSV with a header (no byte-order mark)."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
