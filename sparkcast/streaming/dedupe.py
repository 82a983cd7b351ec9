"""Exactly-once URLs over continuously landing news records.

``dropDuplicates(url)`` in Structured Streaming keeps every seen URL in the
checkpointed state store, so a restarted or re-planned query never emits a
URL twice; ``dropDuplicatesWithinWatermark`` is the bounded-state variant
(older repeats may come back once their state expires). For the exact
first-seen rule across ordered queries use :func:`first_seen_batches`, which
applies the batch operator to each micro-batch against the visited table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedupe_stream(spark: SparkSession, source: str, schema: StructType, url: str = "url",
                  out: str | None = None, checkpoint: str | None = None,
                  event_time: str | None = None, delay: str = "7 days",
                  max_files_per_trigger: int | None = None, fmt: str = "parquet",
                  state: str | None = ROCKSDB) -> str:
    """Run the dedupe stream over everything landed at ``source`` (trigger
    availableNow) and return the output path. Output and checkpoint default
    to fresh folders under the shared checkpoint directory."""
    run = uuid.uuid4().hex[:12]
    out = out or scratch_path(spark, f"url_stream/{run}/out")
    checkpoint = checkpoint or scratch_path(spark, f"url_stream/{run}/ckpt")
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    s = r.load(source)
    # the state holds a digest per URL, on disk rather than on the heap
    s = s.withColumn("_key", F.sha2(F.col(url), 256))
    if event_time:
        s = s.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"])
    else:
        s = s.dropDuplicates(["_key"])
    before = spark.conf.get(STATE_PROVIDER)
    if state:
        spark.conf.set(STATE_PROVIDER, state)
    try:                                    # a query keeps the provider it starts with
        q = (s.drop("_key").writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(out))
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_PROVIDER, before)
    return out


def first_seen_batches(spark: SparkSession, source: str, schema: StructType, order: list[str],
                       url: str = "url", visited_path: str | None = None,
                       checkpoint: str | None = None, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> str:
    """U5/W4 per micro-batch: keep each batch's first hit per URL not in the
    visited table, append the kept rows to the visited table. Returns the
    visited table path.

    The table is partitioned by (run, batch): the run is the stream's query
    id, which its checkpoint keeps, so a retried batch replaces exactly what
    it wrote and a stream with a new checkpoint never touches older rows."""
    from ..operators.articles import first_seen

    name = uuid.uuid4().hex[:12]
    visited_path = visited_path or scratch_path(spark, f"first_seen/{name}/visited")
    checkpoint = checkpoint or scratch_path(spark, f"first_seen/{name}/ckpt")

    def batch(df: DataFrame, batch_id: int) -> None:
        sess = df.sparkSession
        run = sess.sparkContext.getLocalProperty("sql.streaming.queryId")
        seen = None
        try:
            seen = (sess.read.parquet(visited_path)
                    .where((F.col("_run") != run) | (F.col("_batch") != batch_id)).select(url))
        except AnalysisException as e:      # first batch: no table yet
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        kept = first_seen(df, order, url, visited=seen)
        # a retried batch overwrites only its own partition (idempotent)
        (kept.withColumns({"_run": F.lit(run), "_batch": F.lit(batch_id)}).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_run", "_batch").parquet(visited_path))

    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    q = (r.load(source).writeStream
         .foreachBatch(batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return visited_path
