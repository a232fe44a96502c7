"""Sinks (S12-S16).

Writers are plain ``DataFrameWriter`` calls: partitioned Parquet for tables,
JSON text for the forecast document.  Paths may be any Hadoop URI.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_station(obs: DataFrame, path: str, station: str = "station", mode: str = "overwrite") -> None:
    """One folder per station, spaces in the name -> ``_``.

    Rows are rebalanced by station folder before the write: each task writes
    few folders (no small-file fan-out), and AQE splits a station with a large
    share of the rows by its measured size, over as many tasks as it needs.
    """
    out = obs.withColumn("station_dir", F.replace(F.col(station), F.lit(" "), F.lit("_")))
    out.hint("rebalance", F.col("station_dir")).write.mode(mode).partitionBy("station_dir").parquet(path)


def write_total(wide: DataFrame, path: str, kind: str) -> str:
    """Whole table, overwritten, with the data kind in the path."""
    target = os.path.join(path, f"kind={kind}")
    wide.write.mode("overwrite").parquet(target)
    return target


def write_latest(df: DataFrame, path: str, as_of) -> str:
    """A timestamped snapshot, which becomes the latest table by being complete.

    Nothing is overwritten: a second run of one time gets the next revision.
    ``read_latest`` takes the newest folder whose job has committed, so a
    reader beside a write, or after one that failed, finds the table before.
    One writer at a time; of two with one folder the second raises.
    """
    stamp = as_of.strftime("%Y%m%d_%H%M%S")
    revision = len(_glob(df.sparkSession, f"{path}/snapshot={stamp}_*"))
    snap = f"{path}/snapshot={stamp}_{revision:04d}"
    df.write.mode("errorifexists").parquet(snap)
    return snap


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete snapshot of ``write_latest``; without one an error."""
    done = _glob(spark, f"{path}/snapshot=*/_SUCCESS")
    if not done:
        raise FileNotFoundError(f"no complete snapshot in {path}")
    return spark.read.parquet(max(done).removesuffix("/_SUCCESS"))


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on the pattern's own file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [f.getPath().toString() for f in found or []]


def write_forecast(doc: DataFrame, path: str) -> None:
    """The forecast document as one JSON value."""
    doc.select(F.to_json(F.struct(*doc.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_forecast(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Forecast document with its declared schema (S16); no inference pass."""
    from aerogrid.plans.model import DOC_SCHEMA
    return spark.read.schema(DOC_SCHEMA).option("multiLine", multi_line).json(path)
