"""Country indicators: payload rows -> tidy long table -> wide table, summary
(S4, P11-P15, A8-A10, J13, U7, K2).

The wide table is one closed pivot over the union of all indicators' long
tables (a single shuffle), instead of one pivot per indicator folded with
outer joins; the result is the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

LONG_COLS = ["countryiso3code", "country_name", "year", "value", "indicator_code", "indicator_name"]


def flatten_observations(rows: DataFrame, indicator_code: str | None = None,
                         start_year: int | None = None, end_year: int | None = None,
                         countries: Sequence[str] | None = None, seq: str | None = None) -> DataFrame:
    """Payload rows (``country{id,value}, countryiso3code,
    date, value, indicator{id,value}``) -> the long table. ``year`` from the
    date string (bad -> null); rows without a value are dropped first, then
    ``value`` is coerced to double (bad -> null, the row stays). ``seq``: a
    load-order column to carry along (for the first value of a cell)."""
    code = F.lit(indicator_code) if indicator_code else F.col("indicator.id")
    out = rows.select(
        F.col("countryiso3code"),
        F.col("country.value").alias("country_name"),
        F.expr("try_cast(date AS INT)").alias("year"),
        F.col("value").alias("_v"),
        code.alias("indicator_code"),
        F.col("indicator.value").alias("indicator_name"), *([F.col(seq)] if seq else []))
    out = out.where(F.col("_v").isNotNull()).withColumn("value", F.expr("try_cast(_v AS DOUBLE)")).drop("_v")
    if start_year is not None and end_year is not None:
        out = out.where(F.col("year").between(start_year, end_year))
    if countries:
        out = out.where(F.col("countryiso3code").isin(list(countries)))
    return out.select(*LONG_COLS, *([seq] if seq else []))


def country_metadata(rows: DataFrame) -> DataFrame:
    """The 8 country fields, nested income level / region flattened."""
    return rows.select("id", "name", "iso2Code", "capitalCity", "longitude", "latitude",
                       F.col("incomeLevel.value").alias("income_level"),
                       F.col("region.value").alias("region_name"))


def real_countries(meta: DataFrame) -> DataFrame:
    """P14 (Q14): rows with both coordinates present; blank counts as missing."""
    def present(c):
        return F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull()
    return meta.where(present("longitude") & present("latitude"))


def wide_table(long: DataFrame, indicators: dict[str, str], years: Sequence[int],
               seq: str | None = None) -> DataFrame:
    """A8 + J13: one row per (countryiso3code, country_name), one column
    ``{indicator}_{year}`` per listed indicator and year; a cell holds the
    first value (by ``seq`` when given, else any) of its group. Rows with a
    null key are dropped, as the pandas pivot does.

    ``indicators`` maps the column prefix to the indicator code.
    """
    keyed = long.where(F.col("countryiso3code").isNotNull() & F.col("country_name").isNotNull()
                       & F.col("year").isNotNull())
    order = F.col(seq) if seq else F.lit(0)
    aggs = []
    for prefix, code in indicators.items():
        for y in years:
            hit = (F.col("indicator_code") == F.lit(code)) & (F.col("year") == F.lit(y)) & F.col("value").isNotNull()
            aggs.append(F.min_by(F.when(hit, F.col("value")), F.when(hit, F.struct(order.alias("o"))))
                        .alias(f"{prefix}_{y}"))
    return keyed.groupBy("countryiso3code", "country_name").agg(*aggs)


def summary(long: DataFrame) -> DataFrame:
    """A9/A10 per indicator: distinct countries, first and last year, rows,
    and the mean value in the indicator's latest year. One pass over the
    long table, then small aggregations; no window over a whole indicator."""
    # one pass over the long table; both results come from this aggregate
    g = long.groupBy("indicator_code", "year", "countryiso3code").agg(
        F.sum("value").alias("s"), F.count("value").alias("cv"), F.count(F.lit(1)).alias("n"))
    from ..session import materialize
    g = materialize(g)
    per_year = (g.groupBy("indicator_code", "year")
                .agg((F.sum("s") / F.sum("cv")).alias("ymean"), F.sum("n").alias("n")))
    s = (per_year.groupBy("indicator_code")
         .agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"),
              F.sum("n").alias("records"), F.max_by("ymean", "year").alias("latest_mean")))
    cn = (g.where(F.col("countryiso3code").isNotNull())
          .select("indicator_code", "countryiso3code").distinct()
          .groupBy("indicator_code").agg(F.count(F.lit(1)).alias("countries")))
    return s.join(cn, "indicator_code", "left").select(
        "indicator_code", F.coalesce("countries", F.lit(0).cast("long")).alias("countries"),
        "year_min", "year_max", "records", "latest_mean")


def all_indicators(longs: Sequence[DataFrame]) -> DataFrame:
    """U7 ``get_all_indicators``: one long table over every indicator; empty
    inputs add nothing. ``indicator_code`` tells the indicators apart."""
    out = None
    for df in longs:
        out = df.select(*LONG_COLS) if out is None else out.unionByName(df.select(*LONG_COLS))
    if out is None:
        raise ValueError("no indicator tables given")
    return out
