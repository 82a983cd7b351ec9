"""Registered queries (stand-in plans over the test tables) and their
DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import data_queries, data_sql, file_queries, geometry, panel_queries, panel_sql, region_queries, region_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for mod in _query_modules():
        out.update(mod.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for mod in _sql_modules():
        out.update({k: f() for k, f in mod.SQL.items()})
    return out


def _query_modules():
    return [panel_queries, region_queries, data_queries, geometry, file_queries]


def _sql_modules():
    return [panel_sql, region_sql, data_sql, geometry, file_queries]
