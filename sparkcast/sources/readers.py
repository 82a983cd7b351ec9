"""Sources (S1-S7): explicit schemas, no inference.

Network fetching (news search, indicator API, browsers) is not part of the
engine: these readers take records already landed in storage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, MapType, StringType,
                               StructField, StructType)

from ..operators.panel import month_of

EVENT_SCHEMA = StructType([
    StructField("year", IntegerType()),
    StructField("event_date", StringType()),
    StructField("event_id_cnty", StringType()),
    StructField("country", StringType()),
    StructField("admin1", StringType()),
    StructField("event_type", StringType()),
    StructField("sub_event_type", StringType()),
])

POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
RINGS = ArrayType(ArrayType(POINT))

BOUNDARY_SCHEMA = StructType([
    StructField("adm0_a3", StringType()), StructField("name_en", StringType()),
    StructField("name", StringType()), StructField("name_alt", StringType()),
    StructField("rings", RINGS), StructField("pos", LongType()),
])

_IDV = StructType([StructField("id", StringType()), StructField("value", StringType())])
OBSERVATION = StructType([
    StructField("indicator", _IDV), StructField("country", _IDV),
    StructField("countryiso3code", StringType()), StructField("date", StringType()),
    StructField("value", StringType()),         # numbers may arrive quoted; coerced after the null filter
])
COUNTRY = StructType([
    StructField("id", StringType()), StructField("name", StringType()), StructField("iso2Code", StringType()),
    StructField("capitalCity", StringType()), StructField("longitude", StringType()),
    StructField("latitude", StringType()), StructField("incomeLevel", _IDV), StructField("region", _IDV),
])

ARTICLE_SCHEMA = StructType([
    StructField("title", StringType()), StructField("description", StringType()),
    StructField("published date", StringType()), StructField("url", StringType()),
    StructField("publisher", StructType([StructField("href", StringType()), StructField("title", StringType())])),
    StructField("country", StringType()), StructField("search", StringType()),
    StructField("full_text", StringType()),
    StructField("query_seq", LongType()), StructField("hit_seq", LongType()),
])

SEARCH_CONFIG = StructType([
    StructField("metrics", ArrayType(StringType())), StructField("searches", ArrayType(StringType())),
    StructField("years", ArrayType(StringType())), StructField("countries", MapType(StringType(), StringType())),
])


#: Name of the column that takes a row's text where it doesn't fit the header.
CORRUPT = "_corrupt"


def _event_files(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files by their header. A header is the line of a file's first block that
    names all event columns: one scan of the lines as text, without parsing, of
    which a row a file comes back. Files without such a line are an error."""
    import csv

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    named = F.lit(True)
    for f in EVENT_SCHEMA:
        named = named & F.col("value").contains(f.name)
    rows = lines.where((F.col("at") == 0) & named).groupBy("file").agg(F.min("value").alias("value")).collect()
    # read from the listing, so that files without rows or headers are seen, too
    files = spark.read.text(path).inputFiles()
    known = {r["file"]: tuple(x.strip().lstrip("\ufeff") for x in next(csv.reader([r["value"]]))) for r in rows}
    found: dict[tuple[str, ...], list[str]] = {}
    same = {k.replace("file:///", "file:/"): v for k, v in known.items()}
    for name in files:
        header = known.get(name) or same.get(name.replace("file:///", "file:/"))
        missing = [f.name for f in EVENT_SCHEMA if not header or f.name not in header]
        if missing:
            raise ValueError(f"{name}: no column {', '.join(missing)}")
        found.setdefault(header, []).append(name)
    return found


def _raw_events(spark: SparkSession, path: str) -> DataFrame:
    """Event rows as text columns, each file read under its own header."""
    out = None
    for header, files in _event_files(spark, path).items():
        schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(header))] + [StructField(CORRUPT, StringType())])
        raw = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", CORRUPT).csv(files))
        at = {name: i for i, name in reversed(list(enumerate(header)))}
        part = raw.select(*[F.col(f"c{at[f.name]}").alias(f.name) for f in EVENT_SCHEMA], CORRUPT)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"{path}: no files")
    return out


def read_events_checked(spark: SparkSession, path: str, start_year: int | None = 2018) -> tuple[DataFrame, DataFrame]:
    """S1 + P1 + P2: (events, quarantine). Each file is read under its own
    header, whatever the order and number of its columns. Rows whose number of
    cells doesn't fit it, without a whole number as year or without a readable date
    go to the quarantine (all columns as text, and ``reason``); every other row
    is an event, apart from those before ``start_year``. ``month`` = first day of
    the event's month."""
    raw = _raw_events(spark, path)
    month = month_of("event_date", "d MMMM yyyy")
    reason = (F.when(F.col(CORRUPT).isNotNull(), "cells").when(F.col("year").try_cast("int").isNull(), "year").when(month.isNull(), "event_date"))
    raw = raw.withColumn("reason", reason)
    good = raw.where("reason IS NULL").select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA]).withColumn("month", month)
    if start_year is not None:
        good = good.where(F.col("year") >= start_year)
    return good, raw.where("reason IS NOT NULL")


def read_events(spark: SparkSession, path: str, start_year: int | None = 2018) -> DataFrame:
    """S1 + P1 + P2 without a quarantine: values that don't fit a column's type
    are null; files may differ in the order and number of their columns (a missing
    one is an error); rows from ``start_year``; ``month`` = first day of the parsed
    event month."""
    df = _raw_events(spark, path).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])
    if start_year is not None:
        df = df.where(F.col("year") >= start_year)
    return df.withColumn("month", month_of("event_date", "d MMMM yyyy"))


def read_boundaries(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: a boundary table already converted to rings (Parquet or JSON lines)."""
    return spark.read.schema(BOUNDARY_SCHEMA).format(fmt).load(path)


def read_payload_rows(spark: SparkSession, path: str, row_schema: StructType = OBSERVATION,
                      seq: str | None = None) -> DataFrame:
    """Files holding one JSON array ``[meta, rows]`` each -> one row per
    element of ``rows``. (A multi-line JSON read fails on this mixed array,
    so each file is read whole and its second element parsed.) ``seq`` names a
    column with the load order: (file name, place in the file)."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    rows = F.from_json(F.get_json_object("value", "$[1]"), ArrayType(row_schema))
    each = raw.select("_file", F.posexplode(rows).alias("_i", "_row")).where(F.col("_row").isNotNull())
    out = [F.col("_row.*")]
    if seq:
        out.append(F.struct(F.col("_file").alias("file"), F.col("_i").alias("place")).alias(seq))
    return each.select(*out)


def read_articles(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """S5 (and S7 for landed search records): article JSON under its schema,
    one record a line (as K3 writes it); ``multiline`` for files that hold one
    JSON array or record each."""
    return spark.read.schema(ARTICLE_SCHEMA).option("multiLine", multiline).json(path)


def read_search_config(spark: SparkSession, path: str, section: str = "testing") -> DataFrame:
    """The search configuration section (metrics, templates, years,
    country -> code map) as one row."""
    schema = StructType([StructField(section, SEARCH_CONFIG)])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(f"{section}.*")


def config_axes(cfg: DataFrame):
    """S6 -> the four ordered axes :func:`search_grid` takes (order = list order)."""
    t = cfg.select(F.posexplode("searches").alias("t_ord", "template"))
    c = cfg.select(F.posexplode(F.map_entries("countries")).alias("c_ord", "e")).select(
        "c_ord", F.col("e.key").alias("country"), F.col("e.value").alias("code"))
    m = cfg.select(F.posexplode("metrics").alias("m_ord", "metric"))
    y = cfg.select(F.posexplode("years").alias("y_ord", "year"))
    return t, c, m, y


def load_or_build(spark: SparkSession, path: str, build, refresh: bool = False) -> DataFrame:
    """S2 (Q1, Q19): read the stored table, or build and store it when
    ``refresh`` is set or nothing is stored yet. Put the build parameters in
    ``path`` so a different configuration never reads a stale table."""
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            # only a table that isn't there is built; any other fault is shown
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
