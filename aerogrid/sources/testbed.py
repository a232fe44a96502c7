"""Test-bed views over the driver tables.

The driver tables hold no air-quality data, so observations are a fixed view
of ``events``: ``station = event_type``, the indicator picked by
``user_id % 3``, ``ts`` truncated to the grain, ``seq = event_id``.  The same
view is written in SQL for the DuckDB oracle (``OBS_SQL``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.sources.tables import table


def indicator_of(user_id) -> Column:
    u = F.col(user_id) if isinstance(user_id, str) else user_id
    m = F.pmod(u, F.lit(3))
    return (F.when(m == 0, K.INDICATORS[0])
            .when(m == 1, K.INDICATORS[1])
            .otherwise(K.INDICATORS[2]))


def truncate_to_grain(ts, grain_seconds: int) -> Column:
    """Floor a ``timestamp_ntz`` to a fixed grain (UTC session)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if grain_seconds == 3600:
        return F.date_trunc("hour", c).cast("timestamp_ntz")
    step = F.lit(int(grain_seconds) * 1_000_000)
    micros = F.unix_micros(c.cast("timestamp"))
    return F.timestamp_micros(F.floor(micros / step).cast("long") * step).cast("timestamp_ntz")


def obs_from_events(events: DataFrame, grain_seconds: int = 3600) -> DataFrame:
    """Long observation table ``(station, indicator, ts, value, units, chunk_no, seq)``.

    NaN is turned into NULL here once (missing = NULL everywhere downstream).
    """
    return events.select(
        F.col("event_type").alias("station"),
        indicator_of("user_id").alias("indicator"),
        truncate_to_grain("ts", grain_seconds).alias("ts"),
        F.nanvl(F.col("value"), F.lit(None).cast("double")).alias("value"),
        F.lit(K.TESTBED_UNITS).alias("units"),
        F.lit(0).alias("chunk_no"),
        F.col("event_id").alias("seq"),
    )


def load_obs(spark: SparkSession, sf_dir: str, grain_seconds: int = 3600) -> DataFrame:
    return obs_from_events(table(spark, sf_dir, "events"), grain_seconds)


def testbed_stations(spark: SparkSession) -> DataFrame:
    """Station dimension ``(station, fmisid, latitude, longitude)``."""
    return spark.createDataFrame(K.TESTBED_STATIONS,
                                 "station string, fmisid int, latitude double, longitude double")


def testbed_series() -> list[tuple[str, str]]:
    """All (station, indicator) pairs of the test bed, station-major."""
    return [(s[0], ind) for s in K.TESTBED_STATIONS for ind in K.INDICATORS]


# SQL twin of ``obs_from_events`` (hourly grain) for DuckDB.
OBS_SQL = f"""
SELECT event_type AS station,
       CASE user_id % 3 WHEN 0 THEN '{K.INDICATORS[0]}'
                        WHEN 1 THEN '{K.INDICATORS[1]}'
                        ELSE '{K.INDICATORS[2]}' END AS indicator,
       CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
       CASE WHEN isnan(value) THEN NULL ELSE value END AS value,
       '{K.TESTBED_UNITS}' AS units,
       0 AS chunk_no,
       event_id AS seq
FROM events
"""

STATIONS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', {f}, CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))" for s, f, lat, lon in K.TESTBED_STATIONS
) + ") AS t(station, fmisid, latitude, longitude)"
