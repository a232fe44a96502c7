"""What the jobs share: observations read, cleaned to one row per key and put on a filled grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerogrid.operators.aggregates import dedup_first
from aerogrid.operators.joins import densify, series_table
from aerogrid.operators.project import require_nonempty
from aerogrid.operators.windows import fill_gaps, require_no_empty_series
from aerogrid.session import cut_lineage
from aerogrid.sources.tables import read_table

KEYS = ["station", "indicator", "ts"]


def observations(spark: SparkSession, path: str, hours: int) -> DataFrame:
    """The last ``hours`` hours of ``(station, indicator, ts, value[, chunk_no,
    seq])`` at ``path``, one row per key; raises if there are none.  NaN counts
    as missing; without arrival columns the smallest value of a key is taken."""
    obs = read_table(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    obs = obs.withColumn("value", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")))
    newest = obs.agg(F.max("ts")).first()[0]
    if newest is not None:
        obs = obs.where(F.col("ts") > F.lit(newest.isoformat(sep=" ")).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    require_nonempty(obs, f"input {path}")
    order = [c for c in ("chunk_no", "seq") if c in obs.columns]
    return dedup_first(obs, KEYS, order) if order else obs.groupBy(*KEYS).agg(F.min("value").alias("value"))


def filled_grid(obs: DataFrame, series: DataFrame | list) -> DataFrame:
    """Dense and filled, landed; a series without any value raises and is named."""
    grid = cut_lineage(densify(obs, series), "grid")
    filled = cut_lineage(fill_gaps(grid), "filled")
    require_no_empty_series(filled)
    return filled


def series_of(obs: DataFrame) -> list[tuple[str, str]]:
    """The (station, indicator) pairs in model order; one pair per model column."""
    return [tuple(r) for r in series_table(obs).orderBy("station", "indicator").collect()]
