"""Core slice: observations -> dedup -> dense grid -> fills -> wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.catalog import register
from aerogrid.operators.aggregates import dedup_first, to_wide
from aerogrid.operators.joins import densify
from aerogrid.operators.windows import fill_gaps
from aerogrid.plans.sqlparts import DEDUP_SQL, FILLED_SQL, GRID_SQL, OBS_SQL, wide_sql
from aerogrid.session import cut_lineage
from aerogrid.sources.tables import table
from aerogrid.sources.testbed import load_obs, obs_from_events, testbed_series

KEYS = ["station", "indicator", "ts"]


def deduped(spark: SparkSession, sf_dir: str, grain: int = 3600) -> DataFrame:
    return dedup_obs(load_obs(spark, sf_dir, grain))


def dedup_obs(obs: DataFrame) -> DataFrame:
    """First row per key.  The unit is one text for all, so it is put back
    behind the aggregate, whose columns then have a fixed width."""
    return dedup_first(obs.drop("units"), KEYS).withColumn("units", F.lit(K.TESTBED_UNITS))


def recent_obs(spark: SparkSession, sf_dir: str, hours: int = K.PREDICT_WINDOW_HOURS) -> DataFrame:
    """Observations of the last ``hours`` hours; the bound reaches the scan."""
    events = table(spark, sf_dir, "events")
    first_hour = F.date_trunc("hour", F.max("ts")) - F.make_dt_interval(F.lit(0), F.lit(hours - 1))
    return obs_from_events(events.where(F.col("ts") >= events.select(first_hour.cast("timestamp_ntz")).scalar()))


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled grid that a prediction run works on: the latest hours alone,
    filled among themselves, landed once for forecast, history and document."""
    grid = cut_lineage(densify(dedup_obs(recent_obs(spark, sf_dir)), testbed_series()))
    return cut_lineage(fill_gaps(grid))


def dense(spark: SparkSession, sf_dir: str, grain: int = 3600) -> DataFrame:
    return densify(deduped(spark, sf_dir, grain), testbed_series())


def filled(spark: SparkSession, sf_dir: str, grain: int = 3600) -> DataFrame:
    """Dense grid landed once (reliable checkpoint), then filled.

    ``fill_gaps`` reads its input twice (block windows and the per-block
    carry summary); landing the grid keeps the raw scan and dedup shuffle
    from running twice.
    """
    return fill_gaps(cut_lineage(dense(spark, sf_dir, grain)))


@register("s1_obs_view", OBS_SQL)
def q_obs(spark, sf_dir):
    return load_obs(spark, sf_dir)


@register("a1_dedup_first", DEDUP_SQL)
def q_dedup(spark, sf_dir):
    return deduped(spark, sf_dir)


@register("j10_densify", GRID_SQL)
def q_densify(spark, sf_dir):
    return dense(spark, sf_dir)


@register("w1_ffill", f"""
SELECT station, indicator, ts,
       last_value(value IGNORE NULLS) OVER (PARTITION BY station, indicator ORDER BY ts
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM ({GRID_SQL}) g
""")
def q_ffill(spark, sf_dir):
    return fill_gaps(dense(spark, sf_dir), backward=False).drop("is_filled")


@register("w2_bfill", FILLED_SQL)
def q_bfill(spark, sf_dir):
    return filled(spark, sf_dir)


@register("a8_wide", wide_sql(FILLED_SQL))
def q_wide(spark, sf_dir):
    return to_wide(filled(spark, sf_dir), testbed_series())
