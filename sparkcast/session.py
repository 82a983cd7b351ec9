"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans joins and partition counts
# from runtime sizes, splits skewed join partitions, and timestamps are UTC.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "sparkcast",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or fetch) a session with the defaults above.

    On a cluster pass ``master=None`` so spark-submit decides; in tests and
    the benchmark pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` (or a checkpoint folder already set on the
    context). Only a local-mode session (tests, the benchmark) may fall back
    to a private temp folder; on a cluster a machine-local folder would not be
    readable by other executors, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (e.g. on HDFS/S3)")
        d = tempfile.mkdtemp(prefix="sparkcast-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name


def materialize(df):
    """Write a small intermediate once as Parquet into the shared checkpoint
    folder and read it back: one job, lineage cut (a lost executor never sends
    later stages back to the raw input), and AQE sees its real size.
    (``Dataset.checkpoint`` would compute an unpersisted plan twice.)"""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"tables/{uuid.uuid4().hex}")
    _written.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_written: list[str] = []


def drop_intermediates() -> int:
    """Delete the intermediate tables that this process has written with
    :func:`materialize`; call it once their results are stored. Returns how
    many went. (Results are lazy, so nothing can be dropped before that.)"""
    from pyarrow import fs
    n = 0
    while _written:
        path = _written.pop()
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[5:]
        where, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        if where.get_file_info(root).type == fs.FileType.Directory:
            where.delete_dir(root)
            n += 1
    return n


def spread(df):
    """Spread CPU-heavy per-row work over all cores when the input arrives in
    fewer partitions than the cluster has (e.g. one large row group). Inputs
    that already have enough splits -- the normal case at scale -- are left
    as they are, so no shuffle is added there."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
