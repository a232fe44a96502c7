"""Registered source / sink / streaming queries.

Each writes what Spark derived from the driver tables to the shared scratch
folder (``spark.checkpoint.dir``) and reads it back through the operator.
"""

from __future__ import annotations

import datetime as dt
import functools
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.catalog import register
from aerogrid.operators import aggregates as A
from aerogrid.plans.catalog_core import deduped, filled
from aerogrid.plans.sqlparts import DEDUP_SQL, FILLED_SQL, OBS_SQL, r6, wide_sql
from aerogrid.session import scratch_path
from aerogrid.sources import sinks
from aerogrid.sources.tables import freshness, read_stations, read_table, table
from aerogrid.sources.testbed import load_obs, testbed_series
from aerogrid.streaming import filling, ingest

CSV_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@register("s2_csv_scan", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_s2(spark, sf_dir):
    path = scratch_path(spark, "events") + ".csv"
    (table(spark, sf_dir, "events").write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", CSV_TS_FORMAT).csv(path))
    return read_table(spark, path, schema=EVENTS_SCHEMA, options={"timestampNTZFormat": CSV_TS_FORMAT})


@register("s12_write_station", f"SELECT station, count(*) AS n_rows FROM ({DEDUP_SQL}) d GROUP BY station")
def q_s12(spark, sf_dir):
    root = scratch_path(spark, "stations")
    sinks.write_station(deduped(spark, sf_dir), root)
    back = spark.read.parquet(root)
    return back.groupBy("station").agg(F.count(F.lit(1)).alias("n_rows"))


@register("s18_read_stations", f"SELECT station, indicator, ts, value FROM ({DEDUP_SQL}) d")
def q_s18(spark, sf_dir):
    root = scratch_path(spark, "stations")
    sinks.write_station(deduped(spark, sf_dir), root)
    names = [s[0] for s in K.TESTBED_STATIONS] + ["Station Not Fetched"]   # a missing one is skipped
    return read_stations(spark, root, names).select("station", "indicator", "ts", "value")


@register("s13_write_total", wide_sql(FILLED_SQL))
def q_s13(spark, sf_dir):
    target = sinks.write_total(A.to_wide(filled(spark, sf_dir), testbed_series()), scratch_path(spark, "total"),
                               "training")
    return spark.read.parquet(target)


@register("s14_write_latest", f"SELECT station, indicator, ts, value FROM ({DEDUP_SQL}) d")
def q_s14(spark, sf_dir):
    d = deduped(spark, sf_dir).select("station", "indicator", "ts", "value")
    as_of = load_obs(spark, sf_dir).select(F.max("ts")).first()[0]
    path = scratch_path(spark, "latest")
    sinks.write_latest(d, path, as_of)
    return sinks.read_latest(spark, path)


@register("s3_format_dispatch", """
SELECT 'parquet' AS suffix, 'read' AS outcome, count(*) AS n_rows, count(DISTINCT event_id) AS n_ids FROM events
UNION ALL SELECT 'csv', 'read', count(*), count(DISTINCT event_id) FROM events
UNION ALL SELECT 'orc', 'ValueError', NULL, NULL
UNION ALL SELECT 'missing', 'FileNotFoundError', NULL, NULL""")
def q_s3(spark, sf_dir):
    """The events by suffix, and the errors of an unknown suffix and a missing path."""
    root = scratch_path(spark, "dispatch")
    events = table(spark, sf_dir, "events")
    events.write.parquet(f"{root}/events.parquet")
    events.write.option("header", True).csv(f"{root}/events.csv")
    found = []
    for suffix, name in [("parquet", "events.parquet"), ("csv", "events.csv"), ("orc", "events.orc"), ("missing", "none.parquet")]:
        try:
            rows = read_table(spark, f"{root}/{name}").agg(F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_ids"))
            found.append(rows.select(F.lit(suffix).alias("suffix"), F.lit("read").alias("outcome"), "n_rows", "n_ids"))
        except (ValueError, FileNotFoundError) as e:
            found.append(spark.range(1).select(F.lit(suffix).alias("suffix"), F.lit(type(e).__name__).alias("outcome"),
                                               F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("long").alias("n_ids")))
    return functools.reduce(DataFrame.unionByName, found)


@register("s4_uri_scan", "SELECT l_returnflag, count(*) AS n_rows, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
def q_s4(spark, sf_dir):
    """A table by its full URI, as one in an object store is read: no local copy."""
    uri = sf_dir if "://" in sf_dir else "file://" + os.path.abspath(sf_dir)
    return read_table(spark, f"{uri}/lineitem.parquet").groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), F.sum("l_linenumber").cast("long").alias("lines"))


FRESH_FILES = 3


@register("s17_freshness", f"""
SELECT true AS "exists", CAST({FRESH_FILES} AS BIGINT) AS n_files, true AS fresh
UNION ALL SELECT false, 0, NULL""")
def q_s17(spark, sf_dir):
    """Freshness of a dataset just written in so many files, and of one that is not there."""
    root = scratch_path(spark, "fresh")
    deduped(spark, sf_dir).repartition(FRESH_FILES).write.parquet(root)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    both = freshness(spark, root, now).unionByName(freshness(spark, root + "-none", now))
    return both.select("exists", "n_files", (F.col("age_hours") < 24.0).alias("fresh"))


@register("t1_stream_ingest", f"SELECT station, indicator, ts, value, units, chunk_no, seq FROM ({OBS_SQL}) o")
def q_t1(spark, sf_dir):
    out = ingest.ingest_observations(spark, sf_dir, EVENTS_SCHEMA)
    return spark.read.parquet(out)


@register("t2_stream_dedup", f"""
SELECT station, indicator, ts, value, seq FROM ({OBS_SQL}) o
QUALIFY row_number() OVER (PARTITION BY station, indicator, ts ORDER BY chunk_no, seq) = 1""")
def q_t2(spark, sf_dir):
    out = ingest.dedup_stream(spark, sf_dir, EVENTS_SCHEMA)
    return ingest.read_dedup(spark, out).select("station", "indicator", "ts", "value", "seq")


@register("t3_hourly_means", f"""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, station, indicator,
       {r6('avg(CASE WHEN isnan(value) THEN NULL ELSE value END)')} AS mean_value, count(*) AS n
FROM (SELECT ts, event_type AS station, value,
             CASE user_id % 3 WHEN 0 THEN '{K.INDICATORS[0]}' WHEN 1 THEN '{K.INDICATORS[1]}'
                              ELSE '{K.INDICATORS[2]}' END AS indicator FROM events) e
GROUP BY 1, 2, 3""")
def q_t3(spark, sf_dir):
    out = ingest.hourly_means_stream(spark, sf_dir, EVENTS_SCHEMA)
    r = ingest.read_hourly_means(spark, out)
    return r.select("window_start", "station", "indicator", (F.round("mean_value", 6) + 0.0).alias("mean_value"), "n")



@register("w2_incremental_fill", FILLED_SQL)
def q_w2_landings(spark, sf_dir):
    """All observations in three landings: even weeks, odd weeks, and late rows of all weeks."""
    obs, root = load_obs(spark, sf_dir), scratch_path(spark, "filled")
    late, week = F.col("seq") % 10 == 0, F.weekofyear("ts") % 2
    for gen, rows in enumerate((~late & (week == 0), ~late & (week == 1), late)):
        filling.land(obs.where(rows), root, gen, testbed_series())
    return filling.read_filled(spark, root)
