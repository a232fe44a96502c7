"""Snapshots and their readers, the look-back window, counts by one aggregate."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.plans.model import data_status, station_snapshot
from aerogrid.sources import sinks

T0 = dt.datetime(2024, 1, 1)


def test_readers_always_find_the_newest_complete_table(spark, tmp_path):
    path = str(tmp_path / "tables")
    with pytest.raises(FileNotFoundError):
        sinks.read_latest(spark, path)
    table = lambda x: spark.createDataFrame([(x,)], "v int")
    value = lambda: [r["v"] for r in sinks.read_latest(spark, path).collect()]
    first = sinks.write_latest(table(1), path, T0)
    held = sinks.read_latest(spark, path)
    assert value() == [1]
    again = sinks.write_latest(table(2), path, T0)          # one time twice: the next revision
    assert value() == [2] and again != first
    os.makedirs(path + "/snapshot=20250101_000000_0000")     # a write that has not committed
    assert value() == [2]
    sinks.write_latest(table(0), path, T0 - dt.timedelta(days=1))   # an older time written later
    assert value() == [2]
    sinks.write_latest(table(3), path, T0 + dt.timedelta(hours=1))
    assert value() == [3]
    assert [r["v"] for r in held.collect()] == [1]           # a reader of the table before is not disturbed


def test_a_failed_write_leaves_the_table_before(spark, tmp_path):
    path = str(tmp_path / "tables")
    sinks.write_latest(spark.range(3), path, T0)
    broken = spark.range(3).select(F.raise_error(F.lit("stopped")).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        sinks.write_latest(broken, path, T0 + dt.timedelta(hours=1))
    assert sinks.read_latest(spark, path).count() == 3


def test_status_counts_every_dataset_in_one_aggregate(spark):
    rows = spark.range(100)
    status = data_status(rows, {"training": F.lit(True), "prediction": F.col("id") >= 70, "none": F.col("id") < 0}, 5, T=20, n=10)
    got = {r["dataset"]: r for r in status.collect()}
    assert [(got[k]["n_rows"], got[k]["available"], got[k]["sufficient"]) for k in ("training", "prediction", "none")] == [
        (100, True, True), (30, True, True), (0, False, False)]
    assert got["training"]["min_required"] == 30 + K.TRAIN_EXTRA_ROWS and got["prediction"]["n_columns"] == 5
    plan = status._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and "Union" not in plan


def test_station_snapshot_is_one_aggregate(spark):
    hist = spark.createDataFrame([("a", "PM10", T0, 9.0), ("a", "PM10", T0 + dt.timedelta(hours=1), 1.0),
                                  ("a", "PM2.5", T0 + dt.timedelta(hours=1), None), ("b", "PM10", T0, 2.0)],
                                 "station string, pollutant string, timestamp timestamp, value double")
    stations = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "station string, latitude double, longitude double")
    snap = station_snapshot(hist, stations)
    got = {r["station"]: (r["no2"], r["pm10"], r["pm25"], r["timestamp"]) for r in snap.collect()}
    assert got == {"a": (None, 1.0, None, T0 + dt.timedelta(hours=1)), "b": (None, None, None, None)}
    plan = snap._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
