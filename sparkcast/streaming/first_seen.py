"""U6/U5/W4 over a stream with bounded work: the first hit of every URL.

A stateful operator keeps one entry a URL (keyed by its digest) in RocksDB. A
micro-batch touches only the URLs that are in it: its cost does not depend on
how much was seen before, and nothing already written is read again. Within a
micro-batch the hit that comes first in ``order`` is kept; a URL seen in an
earlier micro-batch, or in the ``visited`` table given at the start, is dropped.

Before the shuffle each task reduces its rows to one a URL and Arrow batch, so a
URL with a third of all hits sends few rows to the task that holds its state.
With an ``event_time``, entries go ``keep`` after the URL's first hit (by the
watermark), which bounds the state; a URL that returns later counts as new.

Defined results: null URLs are one URL; nulls in ``order`` come first; ties in
``order`` are broken by the whole row; an empty stream writes an empty table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import scratch_path
from .dedupe import ROCKSDB, STATE_PROVIDER

KEY = "_key"
_UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _millis(span: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", span)
    if not m:
        raise ValueError(f"{span!r} is no span like '30 days'")
    return int(m[1]) * _UNITS[m[2]]


def _rank(row: Row, order: Sequence[str]):
    """Nulls first, then by value; the whole row breaks ties."""
    return [(row[o] is not None, row[o] if row[o] is not None else 0) for o in order] + [tuple(map(repr, row))]


class FirstSeen(StatefulProcessor):
    """Emits the first row of a key once; ``keep``: milliseconds an entry lives, 0 for ever."""

    def __init__(self, order: Sequence[str], event_time: str | None = None, keep: int = 0):
        self.order, self.event_time, self.keep = list(order), event_time, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        if self.seen.exists():
            for _ in rows:
                pass
            return
        first = min(rows, key=lambda r: _rank(r, self.order))
        self.seen.update((True,))
        if self.keep:
            at = first[self.event_time]
            start = int(at.timestamp() * 1000) if at is not None else 0
            self.handle.registerTimer(max(start, timerValues.getCurrentWatermarkInMs()) + self.keep)
        yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def _one_a_key(order: Sequence[str]):
    """The first row of every key of each Arrow batch."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).append_column("_at", pa.array(range(b.num_rows), pa.int64()))
            idx = pc.sort_indices(t, sort_keys=[(KEY, "ascending"), *[(o, "ascending") for o in order]], null_placement="at_start")
            t = t.take(idx)
            keys = t[KEY].combine_chunks()
            new = pa.concat_arrays([pa.array([True]), pc.not_equal(keys[1:], keys[:-1])]) if len(keys) > 1 else pa.array([True])
            first = t.filter(new)
            if any(first[o].null_count for o in order):
                first = t                   # Arrow's join knows no nulls: the state's task decides
            else:
                # rows that tie with the first stay too: the whole row decides between them later
                first = t.join(first.select([KEY, *order]), [KEY, *order], join_type="left semi")
            yield from first.select(b.schema.names).cast(b.schema).to_batches()
    return run


def first_seen_stream(spark: SparkSession, source: str, schema: StructType, order: Sequence[str], url: str = "url", out: str | None = None,
                      checkpoint: str | None = None, visited: DataFrame | None = None, event_time: str | None = None, keep: str | None = None,
                      delay: str = "1 day", fmt: str = "parquet", max_files_per_trigger: int | None = None) -> str:
    """Run the stream over all that has landed at ``source`` (trigger
    availableNow); returns the folder of kept hits. Run again with the same
    ``out`` and ``checkpoint`` to go on with what landed since."""
    if keep and not event_time:
        raise ValueError("keep needs an event_time")
    run = uuid.uuid4().hex[:12]
    out = out or scratch_path(spark, f"first_seen/{run}/out")
    checkpoint = checkpoint or scratch_path(spark, f"first_seen/{run}/ckpt")
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    digest = F.sha2(F.coalesce(F.concat(F.lit("u"), F.col(url)), F.lit("")), 256)
    s = r.load(source).withColumn(KEY, digest)
    s = s.mapInArrow(_one_a_key(order), s.schema)
    if event_time:
        s = s.withWatermark(event_time, delay)
    initial = None
    if visited is not None:
        initial = visited.select(F.sha2(F.coalesce(F.concat(F.lit("u"), F.col(visited.columns[0])), F.lit("")), 256).alias(KEY)).distinct().groupBy(KEY)
    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:                                    # a query keeps the provider it starts with
        kept = s.groupBy(KEY).transformWithState(
            statefulProcessor=FirstSeen(order, event_time, _millis(keep) if keep else 0), outputStructType=s.schema, outputMode="Append",
            timeMode="EventTime" if keep else "None", initialState=initial)
        q = (kept.drop(KEY).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(out))
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_PROVIDER, before)
    return out
