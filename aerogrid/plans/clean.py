"""The cleaning step as one operator: duplicates dropped, rows in time order,
gaps filled forward, the zone attached (A2, O1, W3, P13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from aerogrid.operators.aggregates import dedup_first
from aerogrid.operators.ordering import sort_by_time
from aerogrid.operators.project import localize, numeric_columns
from aerogrid.operators.windows import ffill_table
from aerogrid.session import cut_lineage


def clean_table(obs: DataFrame, cols: Sequence[str] | None = None, ts: str = "ts", station: str = "station",
                tz: str = "Europe/Helsinki", order: Sequence[str] = ("chunk_no", "seq"), name: str = "ts_utc") -> DataFrame:
    """The first row per (time, station), ``cols`` (the numeric columns by
    default) filled forward over the whole table in time order (ties by
    station), a UTC instant ``name`` beside the local time, sorted by time.

    The deduplicated rows are landed once: the fill reads them twice.  A value
    before the first known one stays null; an empty table gives an empty one.
    """
    first = cut_lineage(dedup_first(obs, [station, ts], order), "clean")
    filled = ffill_table(first, list(cols) if cols is not None else [c for c in numeric_columns(first) if c not in order],
                         ts, tiebreak=[station])
    return sort_by_time(localize(filled, ts, tz, name=name), ts)
