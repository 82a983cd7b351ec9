"""Stand-in relations: the engine's roles played by the test tables.

The test tables have no conflict events, boundaries or articles, so each
role is a projection of them (see README "Stand-ins"). Every stand-in reads
whole tables and scales with them; nothing is sampled or capped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.adjacency import edges_from_rings, square_rings

# Fixed stand-in parameters (the reference's own values are in README):
START_YEAR = 1997                      # P1: keep events from this year on
EVENT_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SUB_EVENT_TYPES = ["F", "P"]           # the two named sub-event columns
TARGETS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
DECAY = 0.05
LAG = 1
HOLDOUT = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events(spark: SparkSession, sf_dir: str, start_year: int = START_YEAR) -> DataFrame:
    """Event rows: orders, region = the customer's nation (null when the
    customer is unknown), month of the order date, type = order priority,
    sub-type = order status. P1 is a range predicate on the raw timestamp so
    it reaches the parquet scan."""
    o = (table(spark, sf_dir, "orders")
         .where(F.col("o_orderdate") >= F.lit(f"{start_year:04d}-01-01 00:00:00").cast("timestamp_ntz"))
         .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"))
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (o.join(cu, o.o_custkey == cu.c_custkey, "left")
            .select(F.col("c_nationkey").alias("region_id"),
                    F.trunc(F.to_date("o_orderdate"), "month").alias("month"),
                    F.col("o_orderpriority").alias("event_type"),
                    F.col("o_orderstatus").alias("sub_event_type")))


def nation_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as a unit square on a 5 x 5 grid: x = region key,
    y = nation key div 5."""
    n = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.col("n_regionkey").alias("x"), F.expr("n_nationkey div 5").alias("y"))
    return square_rings(n, "n_nationkey", "x", "y")


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge table of the panel: nations whose squares touch."""
    return edges_from_rings(nation_boundaries(spark, sf_dir))


def customer_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a unit square at (nation key, customer key): a
    boundary set that grows with the customer table."""
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return square_rings(cu, "c_custkey", "c_nationkey", "c_custkey")
