"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC wall clock (timestamps are naive UTC), AQE
# for runtime coalescing / skew splitting, no web UI.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "aerogrid", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's base settings.

    On a cluster ``master`` stays ``None`` so that spark-submit decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # Runtime-settable SQL confs also apply to a reused session.
    for k, v in conf.items():
        if k.startswith("spark.sql."):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on a live session
                pass
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the engine relies on to a session built
    elsewhere (UTC session zone, AQE), and make sure a checkpoint folder is
    known.  Static settings of that session are left as they are."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql.") and spark.conf.get(k, None) != v:
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on a live session
                pass
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (``--py-files``).

    Pandas-UDF code pickles references to package functions; executors start
    from their own working folder, so the package is zipped once on the
    driver and added with ``addPyFile``, which Spark copies to every node.
    """
    sc = spark.sparkContext
    with _SHIP_LOCK:   # jobs may be submitted from several driver threads
        if sc.applicationId not in _SHIPPED:
            _add_package(sc)
            _SHIPPED.add(sc.applicationId)


def _add_package(sc) -> None:
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="aerogrid-pyfiles-"), "aerogrid.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is unset
    and the master is local (tests), a scratch folder is created and
    registered; on a cluster a machine-local folder would lose data, so an
    unset one is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="aerogrid-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder for materialised tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Land a frame as a Parquet table under the shared checkpoint folder and
    read it back.

    Survives executor loss (the data is on shared storage), computes the
    input once (``checkpoint()`` runs it a second time for the write), and
    later reads get column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the tables that ``cut_lineage`` landed for ``frames``, once
    nothing reads them any more (a loop's last-but-one table, a stage's
    input).  Frames that were not landed are left alone."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            df._scratch = None
