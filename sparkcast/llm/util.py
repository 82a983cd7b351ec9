"""Small Spark helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkcast.session import materialize

BITS = 1 << 23          # of the membership filter: 2**17 rows of 64 bits at most


def save(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: lineage is cut and
    what it holds survives lost executors."""
    return materialize(df)


def maybe_flag(df: DataFrame, key: Column, keys: DataFrame, name: str, flag: str = "_maybe") -> DataFrame:
    """Add whether the key of a row may be among column ``name`` of ``keys``: a
    bit set of ``BITS`` bits is broadcast, at most 2**17 rows however many keys
    there are. False is certain; an exact join follows for the others."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    bits = (keys.select(at(F.col(name)).alias("_b"))
            .groupBy(F.shiftright("_b", 6).cast("int").alias("_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 as int))")).alias("_bits")))
    return (df.withColumn("_bit", at(key)).withColumn("_word", F.shiftright("_bit", 6).cast("int"))
            .join(F.broadcast(bits), "_word", "left")
            .withColumn(flag, F.expr("coalesce(shiftrightunsigned(_bits, cast(_bit & 63 as int)) & 1 = 1, false)"))
            .drop("_word", "_bits", "_bit"))


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """The rows that may have a partner in ``keys`` (see maybe_flag)."""
    return maybe_flag(df, key, keys, name).filter("_maybe").drop("_maybe")


def renamed(df: DataFrame, names) -> DataFrame:
    """``df`` without the columns that an operator is about to add."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
