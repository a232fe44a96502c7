"""Gap filling kept up to date over landings (W1, W2 behind T1).

The filled grid is stored by blocks of time (weeks).  A landing merges its rows
into the blocks they belong to and fills again only these and the blocks whose
carried value changed by them: a late value reaches forward over a series'
empty weeks, up to its next known value, and no further.

Under ``root``:

- ``obs/gen=N/blk=D``     first copies of the observations of a block,
- ``carry/gen=N``         per series and block: first and last known value,
  whether the block starts without one, and what its leading gap gets,
- ``filled/gen=N/blk=D``  the block filled,
- ``index/gen=N``         per block the landing whose ``obs`` and ``filled``
  count, written last and as one file.

A landing ``N`` builds on the newest index below ``N`` and overwrites whatever
an earlier try of ``N`` left, so it can be repeated.  Readers take the newest
index, so they see whole landings only.  ``vacuum`` removes what no index
entry names any more.

What grows with the rows is read and written per touched block.  ``carry`` has
a row per series and week and is rewritten whole; the index and the lists of
blocks on the driver have an entry per week.

Rows without ``ts`` have no place on the grid and are left out.  Repeated rows
and copies of a key over any number of landings: the first by ``chunk_no``,
then ``seq`` (A1).  A series without any value stays null, and an empty landing
changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aerogrid.operators.aggregates import dedup_first
from aerogrid.operators.joins import densify
from aerogrid.session import cut_lineage, discard, scratch_path
from aerogrid.sources.testbed import obs_from_events
from aerogrid.streaming.ingest import ARRIVAL, KEYS, landed_events

SERIES = ["station", "indicator"]
BLOCK = "week"
FILLED_SCHEMA = "station string, indicator string, ts timestamp_ntz, value double, is_filled boolean, blk date"
CARRY_SCHEMA = "station string, indicator string, blk date, first double, last double, starts_empty boolean, lead double"

Index = dict[dt.date, tuple[int, int]]   # block -> landing of its obs, landing of its filled rows


def _block(ts: str = "ts") -> Column:
    return F.date_trunc(BLOCK, F.col(ts)).cast("date")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def newest(spark: SparkSession, root: str, below: int | None = None) -> tuple[int | None, Index]:
    """The newest landing (before landing ``below``) and its index."""
    fs, at = _fs(spark, f"{root}/index")
    if not fs.exists(at):
        return None, {}
    done = [int(s.getPath().getName().removeprefix("gen=")) for s in fs.listStatus(at)
            if s.getPath().getName().startswith("gen=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [g for g in done if below is None or g < below]
    if not done:
        return None, {}
    rows = spark.read.schema("blk date, obs bigint, filled bigint").parquet(f"{root}/index/gen={max(done)}").collect()
    return max(done), {r.blk: (r.obs, r.filled) for r in rows}


def _read(spark: SparkSession, root: str, what: str, schema, gens: dict[dt.date, int]) -> DataFrame:
    """The rows of the blocks in ``gens``, each from the landing named there."""
    paths = [f"{root}/{what}/gen={g}/blk={b.isoformat()}" for b, g in sorted(gens.items())]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{what}").parquet(*paths).drop("gen")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("blk").parquet(path)


def _blocks(df: DataFrame) -> list[dt.date]:
    return sorted(r.blk for r in df.select("blk").distinct().collect())


def land(obs: DataFrame, root: str, gen: int, series) -> list[dt.date]:
    """Merge the observations of landing ``gen`` (0, 1, ...) into the filled
    grid of ``series`` under ``root``; the blocks filled again."""
    spark = obs.sparkSession
    base, index = newest(spark, root, gen)
    columns = [*KEYS, "value", *ARRIVAL]
    new = dedup_first(obs.select(*columns).where(F.col("ts").isNotNull()), KEYS).withColumn("blk", _block())
    new = cut_lineage(new, "landing")
    touched = _blocks(new)

    stored = _read(spark, root, "obs", new.schema, {b: index[b][0] for b in touched if b in index})
    _write(dedup_first(stored.unionByName(new), [*KEYS, "blk"]), f"{root}/obs/gen={gen}")
    obs_at = {b: o for b, (o, _) in index.items()} | {b: gen for b in touched}

    def grid(blocks):
        known = _read(spark, root, "obs", new.schema, {b: obs_at[b] for b in blocks})
        return densify(known.select(*KEYS, "value"), series).withColumn("blk", _block())

    # a block's summary, and what its leading gap gets: the value before it, else its own first, else the next one
    known_at = F.when(F.col("value").isNotNull(), F.col("ts"))
    fresh = grid(touched).groupBy(*SERIES, "blk").agg(
        F.min_by("value", known_at).alias("first"), F.max_by("value", known_at).alias("last"),
        F.min_by("value", "ts").isNull().alias("starts_empty"))
    carry = fresh.withColumn("was", F.lit(None).cast("double"))
    if base is not None:
        old = spark.read.schema(CARRY_SCHEMA).parquet(f"{root}/carry/gen={base}").where(~F.col("blk").isin(touched))
        carry = carry.unionByName(old.withColumnRenamed("lead", "was"))
    w = Window.partitionBy(*SERIES).orderBy("blk")
    before = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    carry = cut_lineage(carry.withColumn("lead", F.coalesce(before, "first", after)), "carry")
    carry.drop("was").write.mode("overwrite").parquet(f"{root}/carry/gen={gen}")
    moved = _blocks(carry.where(F.col("starts_empty") & ~F.col("lead").eqNullSafe(F.col("was")) & ~F.col("blk").isin(touched)))

    again = sorted({*touched, *moved})
    inside = Window.partitionBy(*SERIES, "blk").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    leads = carry.where(F.col("blk").isin(again)).select(*SERIES, "blk", "lead")
    value = F.coalesce(F.last("value", ignorenulls=True).over(inside), "lead")
    filled = grid(again).join(leads, [*SERIES, "blk"], "left").select(
        *KEYS, value.alias("value"), (F.col("value").isNull() & value.isNotNull()).alias("is_filled"), "blk")
    _write(filled, f"{root}/filled/gen={gen}")

    filled_at = {b: f for b, (_, f) in index.items()} | {b: gen for b in again}
    rows = [(b, obs_at[b], filled_at[b]) for b in sorted(filled_at)]
    spark.createDataFrame(rows, "blk date, obs bigint, filled bigint").coalesce(1).write.mode("overwrite").parquet(f"{root}/index/gen={gen}")
    discard(new, carry)
    return again


def read_filled(spark: SparkSession, root: str) -> DataFrame:
    """The filled grid as of the newest landing: the result of ``fill_gaps`` on
    the dense grid of all that has landed."""
    _, index = newest(spark, root)
    return _read(spark, root, "filled", FILLED_SCHEMA, {b: f for b, (_, f) in index.items()}).drop("blk")


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove folders that the newest index does not name; how many went.
    Not while a landing runs or a reader still uses an older index."""
    gen, index = newest(spark, root)
    if gen is None:
        return 0
    live = {f"{what}/gen={at[i]}/blk={b.isoformat()}" for b, at in index.items() for i, what in ((0, "obs"), (1, "filled"))}
    live |= {f"carry/gen={gen}", f"index/gen={gen}"}
    gone = 0
    for what, depth in (("obs", "gen=*/blk=*"), ("filled", "gen=*/blk=*"), ("carry", "gen=*"), ("index", "gen=*")):
        fs, at = _fs(spark, f"{root}/{what}/{depth}")
        for s in fs.globStatus(at) or []:
            name = "/".join(str(s.getPath().toString()).rstrip("/").split("/")[-1 - depth.count("/"):])
            if f"{what}/{name}" not in live:
                fs.delete(s.getPath(), True)
                gone += 1
    return gone


def fill_stream(spark: SparkSession, folder: str, schema: StructType, series, root: str | None = None,
                ckpt: str | None = None, max_files: int | None = None, name: str = "events.parquet") -> str:
    """Landed events -> the filled grid, one landing a micro-batch."""
    root = root or scratch_path(spark, "stream-filled")
    events = obs_from_events(landed_events(spark, folder, schema, name, max_files))
    q = (events.writeStream.foreachBatch(lambda df, n: land(df, root, n, series) and None)
         .option("checkpointLocation", ckpt or root + "-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return root
