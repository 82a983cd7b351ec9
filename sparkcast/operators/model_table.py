"""M7 end to end: raw events + boundary table -> model table.

Composition of the operators, in the original order: country codes and name
fixes (P6-P8), region matching on distinct keys (J6) and map-back (J7),
boundary preparation (U2-U4), adjacency (J8), the panel (A3-A5, J12, W1, F21,
W2) and the column selection (P3). One lazy plan apart from the small
intermediates the operators write once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from . import fixed_values as FV
from .adjacency import edges_from_rings, parent_pairs, prepare_boundaries
from .panel import build_panel, model_table
from ..session import materialize
from .regions import attach_regions, match_regions, prepare_event_keys, region_id


def matched_events(events: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Events (S1 schema + ``month``) with ``matched_admin1_id`` (null when
    no region matches)."""
    keyed = prepare_event_keys(events)
    keys = keyed.select(F.col("country_code").alias("country"), F.col("admin1_norm").alias("key"))
    matches = match_regions(keys.where(F.col("country").isNotNull()), boundaries)
    return attach_regions(keyed, matches)


def build_model_table(events: DataFrame, boundaries: DataFrame, second_set: DataFrame | None = None,
                      types: Sequence[str] = FV.EVENT_TYPES, subtypes: Sequence[str] = FV.SUB_EVENT_TYPES,
                      predictors: Sequence[str] = FV.PREDICTORS, targets: Sequence[str] = FV.TARGETS,
                      lag: int = 1, decay: float = 0.05, base_year: int = FV.START_YEAR,
                      cell: float | None = None) -> DataFrame:
    """``events``: :func:`sources.readers.read_events` output; ``boundaries``:
    the S3 table (``adm0_a3, name_en, name, name_alt, rings, pos``);
    ``second_set``: replacement regions (``adm0_a3, name_en, rings``) for the
    listed countries, or None; merged regions (U3, U4) are always made."""
    b = materialize(prepare_boundaries(boundaries, second_set, country_col="adm0_a3"))
    # one pass over the raw events: everything below needs only these
    # columns, so the rows collapse to distinct combinations with a count
    pre = materialize(events.groupBy(
        F.substring("event_id_cnty", 1, 3).alias("event_id_cnty"), "country", "admin1", "month",
        "event_type", "sub_event_type").agg(F.count(F.lit(1)).alias("events")))
    ev = (matched_events(pre, b)
          .select(F.col("matched_admin1_id").alias("region_id"), "month", "event_type", "sub_event_type", "events"))
    edges = edges_from_rings(b.select(region_id().alias("region_id"), "rings").where(F.col("region_id").isNotNull()),
                             cell=cell, overlaps=parent_pairs(b.sparkSession))
    panel = build_panel(ev, edges, "event_type", types, "sub_event_type", subtypes,
                        lag=lag, decay=decay, base_year=base_year, weight="events")
    return model_table(panel, predictors, targets)
