"""Row counts per pipeline stage.

``observed`` marks a stage; its count comes with the run that the pipeline makes
anyhow (Spark's observed metrics), without a scan of its own. ``stage_counts``
counts stages that nothing else computes, as one small table (one distributed
count a stage, unioned; nothing is looped over on the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


class StageCounts:
    """Counts of the rows that pass marked places of a pipeline.

    A row passing twice (a stage that several outputs read) counts in the first
    action that runs it; retried tasks count once. ``table`` waits for an action."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def observed(self, df: DataFrame, stage: str) -> DataFrame:
        """``df``, with its rows counted as ``stage`` when it is run."""
        if stage in self.seen:
            raise ValueError(f"stage {stage!r} is counted already")
        self.seen[stage] = Observation(f"stage_{len(self.seen)}_{stage}")
        return df.observe(self.seen[stage], F.count(F.lit(1)).alias("rows"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, rows), in the order the stages were marked."""
        return spark.createDataFrame([(k, int(v.get["rows"])) for k, v in self.seen.items()], "stage string, rows long")


def stage_counts(**stages: DataFrame) -> DataFrame:
    out = None
    for name, df in stages.items():
        c = df.select(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows"))
        out = c if out is None else out.unionByName(c)
    return out
