"""Sorts, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.operators.aggregates import dedup_first
from aerogrid.operators.joins import in_windows


def sort_by_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Total order by time (O1): a range-partitioned sort, no single task."""
    return df.orderBy(ts)


def tail_rows(df: DataFrame, k: int, ts: str = "ts") -> DataFrame:
    """Last ``k`` rows by time (O2): planned as TakeOrderedAndProject (top-k per
    partition, then merge), never a full sort."""
    return df.orderBy(F.col(ts).desc()).limit(k)


def order_labels(df: DataFrame, pollutant: str = "pollutant", station: str = "station") -> DataFrame:
    """Pollutants descending, stations ascending (O3)."""
    return df.orderBy(F.col(pollutant).desc(), F.col(station).asc())


def union_chunks(dfs: Sequence[DataFrame]) -> DataFrame:
    """Concatenate chunk tables by name, tolerating missing columns.

    Each input should already carry its ``chunk_no`` (newest = 0)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_windows(obs: DataFrame, windows: DataFrame, keys: Sequence[str] = ("station", "indicator", "ts"),
                  order: Sequence[str] = ("chunk_no", "seq"), ts: str = "ts") -> DataFrame:
    """The union of what every fetch window holds, the first copy of each key
    in ``order`` (U1 over a table of windows).

    The chunks are rows tagged with their window's ``chunk_no``, not one frame
    per window, so the plan is the same for 5 windows and for 5,000."""
    tagged = in_windows(obs.drop("chunk_no"), windows, ts)
    return dedup_first(tagged.drop("start", "end"), keys, order)


def label_union(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct labels found on either side."""
    return a.select(col).union(b.select(col)).distinct()
