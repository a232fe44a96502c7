"""Table readers.

Readers are thin on purpose: Spark's own file sources do pushdown, pruning and
splitting; we only add the format dispatch and the error contract.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _format_of(path: str) -> str:
    p = path.rstrip("/").lower()
    if p.endswith(".parquet"):
        return "parquet"
    if p.endswith(".csv"):
        return "csv"
    raise ValueError(f"Unsupported file format: {path}")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               options: dict | None = None) -> DataFrame:
    """Read a Parquet or CSV table by suffix.

    * unknown suffix -> ``ValueError``
    * missing path -> ``FileNotFoundError``, as Spark finds it on the path's own file system
    * object-store URIs (``s3a://`` ...) are handed to Spark directly; no temp copy.
    """
    fmt = _format_of(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    try:
        if fmt == "parquet":
            return reader.parquet(path)
        # CSV: header row; schema inference only when no schema is given.
        return reader.csv(path, header=True, inferSchema=schema is None)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from e
        raise


def read_stations(spark: SparkSession, root: str, names: list[str] | None = None,
                  strict: bool = False) -> DataFrame:
    """Merge per-station data written with ``partitionBy('station_dir')``.

    Missing stations are skipped (no rows) unless ``strict``; the station filter
    prunes partitions, so only the asked-for folders are listed and read.
    """
    df = spark.read.parquet(root)
    if names is None:
        return df
    dirs = [n.replace(" ", "_") for n in names]
    df = df.where(F.col("station_dir").isin(dirs))
    if strict:
        found = {r[0] for r in df.select("station_dir").distinct().collect()}
        missing = [n for n, d in zip(names, dirs) if d not in found]
        if missing:
            raise KeyError(f"stations missing: {missing}")
    return df


def freshness(spark: SparkSession, path: str, as_of) -> DataFrame:
    """Dataset freshness (S17): exists, last_modified, age_hours.

    Lists the files (path and modification time, no content); one aggregate
    row.  A path that does not exist yields ``exists = false`` and NULLs; any
    other failure is raised.
    """
    from aerogrid.functions.scalars import age_hours, ts_lit

    as_of_col = ts_lit(as_of)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(1).select(
            F.lit(False).alias("exists"),
            F.lit(None).cast("timestamp_ntz").alias("last_modified"),
            F.lit(None).cast("double").alias("age_hours"),
            F.lit(0).cast("long").alias("n_files"))
    agg = files.agg(F.max(F.col("modificationTime").cast("timestamp_ntz")).alias("last_modified"),
                    F.count("path").alias("n_files"))
    return agg.select(
        (F.col("n_files") > 0).alias("exists"),
        F.col("last_modified"),
        age_hours(as_of_col, F.col("last_modified")).alias("age_hours"),
        F.col("n_files"))
