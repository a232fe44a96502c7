"""Join operators.

Broadcasts are only forced for sides whose size is known: literal dimension
tables, one-row aggregates, or a side counted first (``broadcast_checked``).
Everything else is left to the planner (sort-merge / AQE broadcast by
measured size).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.functions.scalars import ts_lit
from aerogrid.session import ship_package

BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20
HOT_CELL_ROWS = 1_000_000   # rows of one time or map cell that one task joins
BOX_EDGES = ["lat_min", "lat_max", "lon_min", "lon_max"]
MOST_CUTS = 1 << 13         # strips an axis is cut into at most


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only after measuring the side; otherwise the plain frame.

    One capped pass (``limit(max_rows + 1)``) counts the rows and sums their
    serialised size (JSON text length, at least the binary size of
    numbers and strings), so checking a big side costs at most
    ``max_rows + 1`` rows of work and the broadcast has a proven bound.
    """
    probe = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))),
                   F.lit(0)).alias("bytes")).first()
    ok = probe["n"] <= max_rows and probe["bytes"] <= max_bytes
    return F.broadcast(df) if ok else df


def merge_on(left: DataFrame, right: DataFrame, on: Sequence[str] | str = "ts",
             how: str = "full_outer") -> DataFrame:
    """Outer merge with one coalesced key column (J1, pair form).  Null keys match each other."""
    keys = [on] if isinstance(on, str) else list(on)
    a, b = left.alias("_l"), right.alias("_r")
    same = reduce(lambda x, y: x & y, [F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`")) for k in keys])
    return a.join(b, same, how).select(
        *[F.coalesce(F.col(f"_l.`{k}`"), F.col(f"_r.`{k}`")).alias(k) for k in keys],
        *[F.col(f"_l.`{c}`") for c in left.columns if c not in keys],
        *[F.col(f"_r.`{c}`") for c in right.columns if c not in keys])


def merge_all(dfs: Sequence[DataFrame], on: str = "ts") -> DataFrame:
    """Left-deep outer merge of many tables (J1).  For station tables prefer
    ``to_wide`` on the long table: one grouped pivot instead of n-1 joins."""
    return reduce(lambda a, b: merge_on(a, b, on), dfs)


def merge_unique(dfs: Sequence[DataFrame], on: str = "ts") -> DataFrame:
    """Outer merge of many tables that are unique on ``on`` (J1): the rows of
    all of them, tagged, in one union and one aggregate, so one exchange
    whatever the number of tables.  Null keys match each other.  A key that
    stands twice in one table raises, since a join would multiply its rows;
    tables that share a column besides the key raise as well."""
    names = [c for df in dfs for c in df.columns if c != on]
    if len({c.lower() for c in names}) < len(names):
        raise ValueError("tables share columns besides the key")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                   [df.withColumn("_src", F.lit(i)) for i, df in enumerate(dfs)])
    bit = F.expr("shiftleft(1L, _src % 62)")
    twice = None
    for g in range(0, len(dfs), 62):   # in each 62 tables a key's bits add up without a carry unless one repeats
        mine = F.when(F.floor(F.col("_src") / 62) == g // 62, bit)
        bad = F.sum(mine) != F.bit_or(mine)
        twice = bad if twice is None else twice | bad
    out = union.groupBy(on).agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in names],
                                F.coalesce(twice, F.lit(False)).alias("_twice"))
    key = F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("repeated key "), F.coalesce(F.col(f"`{on}`").cast("string"), F.lit("NULL"))))
                 .cast(out.schema[on].dataType)).otherwise(F.col(f"`{on}`"))
    return out.select(key.alias(on), *[F.col(f"`{c}`") for c in names])


def series_table(obs: DataFrame, station: str = "station", indicator: str = "indicator") -> DataFrame:
    """Distinct (station, indicator) pairs of the observations, as a table."""
    return obs.select(station, indicator).distinct()


def densify(obs: DataFrame, series: DataFrame | Sequence[tuple[str, str]], ts: str = "ts",
            station: str = "station", indicator: str = "indicator", value: str = "value",
            step_hours: int | None = None) -> DataFrame:
    """Dense grid: every timestamp present x every series, NULL where missing.

    ``obs`` must be unique per (station, indicator, ts) (run ``dedup_first``).
    One shuffle by ``ts`` builds a per-timestamp map series -> value (its size
    is bounded by the number of series); the grid rows come from exploding the
    series against it.  ``series`` is a table with the station and indicator
    columns (see ``series_table``) or a list of pairs; either way it reaches the plan as
    one array from a scalar subquery, not as an expression per series.

    ``step_hours`` (quirk Q2 switch): the time axis is every ``step_hours``
    from the first to the last timestamp, so a time step missing from all
    series becomes a row of NULLs that the fills then cover (the default keeps
    the original: only timestamps some series has).  The axis is generated
    from the two bounds, spread over tasks, and outer-joined by ``ts``.
    """
    if not isinstance(series, DataFrame):
        series = obs.sparkSession.createDataFrame([tuple(x) for x in series], f"`{station}` string, `{indicator}` string")
    sep = "\u0001"
    entry = F.struct(F.concat_ws(sep, F.col(station), F.col(indicator)).alias("k"), F.col(value).alias("v"))
    per_ts = obs.groupBy(ts).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    if step_hours:
        bounds = obs.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
        n_steps = F.floor((F.unix_micros(F.col("_hi").cast("timestamp")) - F.unix_micros(F.col("_lo").cast("timestamp")))
                          / F.lit(step_hours * 3_600_000_000)).cast("long")
        # one row per step: ranges of 1024 step numbers first, so the expansion
        # is spread over many rows (and tasks) instead of one
        chunks = bounds.select("_lo", n_steps.alias("_n")).select(
            "_lo", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / 1024).cast("long")))
            .alias("_c"))
        chunks = chunks.repartition(F.col("_c"))
        steps = chunks.select("_lo", F.explode(F.sequence(
            F.col("_c") * 1024, F.least(F.col("_c") * 1024 + 1023, F.col("_n")))).alias("_k"))
        axis = steps.select((F.col("_lo") + F.make_dt_interval(F.lit(0), (F.col("_k") * step_hours).cast("int")))
                            .cast("timestamp_ntz").alias(ts))
        # steps with no observation get a NULL map: every series reads NULL there
        per_ts = axis.join(per_ts, ts, "full_outer")
    grid = series.agg(F.collect_list(F.struct(station, indicator))).scalar()
    ex = per_ts.select(ts, "_m", F.explode(grid).alias("_s"))
    return ex.select(F.col(f"_s.{station}").alias(station), F.col(f"_s.{indicator}").alias(indicator), ts,
                     F.col("_m")[F.concat_ws(sep, F.col(f"_s.{station}"), F.col(f"_s.{indicator}"))]
                     .alias(value))


def bbox(lat: float, lon: float, side_km: float = K.SQUARE_SIDE_KM):
    """Bounding box (lat_min, lat_max, lon_min, lon_max) around a centre.

    +- side/111 degrees of latitude, +- side/(111 cos lat) of longitude.
    Column form: ``bbox_columns``.
    """
    import math
    dlat = side_km / K.KM_PER_DEGREE
    dlon = side_km / (K.KM_PER_DEGREE * math.cos(lat * math.pi / 180.0))
    return lat - dlat, lat + dlat, lon - dlon, lon + dlon


def bbox_columns(lat, lon, side_km: float = K.SQUARE_SIDE_KM) -> list[Column]:
    la = F.col(lat) if isinstance(lat, str) else lat
    lo = F.col(lon) if isinstance(lon, str) else lon
    dlat = F.lit(side_km / K.KM_PER_DEGREE)
    dlon = F.lit(side_km) / (F.lit(K.KM_PER_DEGREE) * F.cos(F.radians(la)))
    return [(la - dlat).alias("lat_min"), (la + dlat).alias("lat_max"),
            (lo - dlon).alias("lon_min"), (lo + dlon).alias("lon_max")]


def within_bbox(stations: DataFrame, box, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Stations inside a box, both ends inclusive."""
    lat_min, lat_max, lon_min, lon_max = box
    return stations.where(F.col(lat).between(lat_min, lat_max) & F.col(lon).between(lon_min, lon_max))


def _known(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])


def in_boxes(points: DataFrame, boxes: DataFrame, lat: str = "lat", lon: str = "lon", hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Every point with every box that holds it, edges included (J2, P9 for any
    number of points and boxes): the columns of both.

    ``boxes`` has ``lat_min, lat_max, lon_min, lon_max`` (``bbox_columns``).  A
    box is filed under the square cells it touches of the power of two next
    above its longer side, nine at most; a point looks up one cell for each
    width in use, and the edges are checked behind the equi-join.  Cells with
    more than ``hot_rows`` points are split by a hash of the point.  Points
    and boxes with a null or NaN coordinate match nothing."""
    edges = BOX_EDGES
    clash = {c.lower() for c in points.columns} & {c.lower() for c in boxes.columns}
    if clash:
        raise ValueError(f"points and boxes share columns: {sorted(clash)}")

    side = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min"), F.lit(2.0 ** -20))
    filed = boxes.where(_known(edges) & (F.col("lat_min") <= F.col("lat_max")) & (F.col("lon_min") <= F.col("lon_max")))
    filed = filed.withColumn("_level", F.ceil(F.log2(side)).cast("int"))
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())
    if not levels:
        return points.join(boxes, F.lit(False))

    def cell(x) -> Column:
        return F.floor(F.col(x).cast("double") / F.pow(F.lit(2.0), F.col("_level"))).cast("long")

    filed = filed.withColumn("_row", F.explode(F.sequence(cell("lat_min"), cell("lat_max"))))
    filed = filed.withColumn("_cell", F.explode(F.sequence(cell("lon_min"), cell("lon_max"))))
    looked = (points.where(_known([lat, lon])).withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels])))
              .withColumn("_row", cell(lat)).withColumn("_cell", cell(lon)))
    key = ["_level", "_row", "_cell"]
    hot = looked.groupBy(*key).agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("_parts")).where("_parts > 1")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), F.coalesce("_parts", F.lit(1))).cast("int")
    left = looked.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    right = filed.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    inside = F.col(lat).between(F.col("lat_min"), F.col("lat_max")) & F.col(lon).between(F.col("lon_min"), F.col("lon_max"))
    return left.join(right, [*key, "_part"]).where(inside).select(*[F.col(f"`{c}`") for c in (*points.columns, *boxes.columns)])


def strip_codes(cuts: Sequence[float]) -> Callable[[str], Column]:
    """Column function: a number's strip among sorted ``cuts``, ascending with
    the number.  A cut is a strip of its own (odd), so are the gaps (even)."""
    at = np.array(cuts, np.float64)

    @F.pandas_udf("int")
    def code(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, x, "left") + np.searchsorted(at, x, "right"))
    return code


def _covering(first: Column, last: Column, depth: int) -> Column:
    """Nodes of the binary tree over codes below ``2 ** depth`` that together
    hold ``first`` to ``last``, each code once: two a level at most.  A node is
    ``(2 ** depth + code) >> level`` of its codes."""
    def at(k: int) -> list[Column]:
        lo, hi = F.ceil(first / F.lit(1 << k)).cast("int"), F.floor((last + 1) / F.lit(1 << k)).cast("int")
        return [F.when((lo < hi) & (lo % 2 == 1), lo + (1 << depth - k)), F.when((lo < hi) & (hi % 2 == 1), hi - 1 + (1 << depth - k))]
    return F.array_compact(F.array(*[n for k in range(depth + 1) for n in at(k)]))


def sums_in_boxes(points: DataFrame, boxes: DataFrame, by: Sequence[str], value: str, lat: str = "lat", lon: str = "lon",
                  cuts: int | None = None, hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Number ``n`` of the pairs of ``in_boxes`` and ``total``, the sum of the
    points' ``value``, by the boxes' columns ``by``; without the pairs
    themselves, whose number grows with points times boxes.

    Both axes are cut into strips at quantiles of the points, and points are
    summed by cell and by every pair of tree nodes above it.  A box takes the
    nodes that cover its whole cells; only points in the strips that an edge
    cuts are joined one by one (``in_boxes`` over codes, the edges checked
    behind it).  A frequent coordinate is a strip of its own and never cut.
    Sums are of values in the box alone, never differences.  Edges are
    included; points and boxes with a null or NaN coordinate match nothing;
    a box row that repeats counts again.  ``cuts`` an axis are by default near
    a quarter of the cube root of points times boxes."""
    ship_package(points.sparkSession)
    by = [by] if isinstance(by, str) else list(by)
    places = points.where(_known([lat, lon])).select(
        F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"), F.col(value).alias("_value"))
    areas = boxes.where(_known(BOX_EDGES)).select(*by, *[F.col(c).cast("double").alias(f"_{c}") for c in BOX_EDGES])
    areas = areas.where("_lat_min <= _lat_max and _lon_min <= _lon_max")
    if cuts is None:
        cuts = min(MOST_CUTS, max(8, round((places.count() * areas.count()) ** (1 / 3) / 4)))
    probs = [i / (cuts + 1) for i in range(1, cuts + 1)]
    found = [sorted(set(q)) for q in places.approxQuantile(["_lat", "_lon"], probs, 0.5 / cuts)]
    depth = max(1, *[(2 * len(q)).bit_length() for q in found])
    y, x = [strip_codes(q) for q in found]
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))   # few files would leave all that follows to few tasks
    places, areas = places.repartition(spread), areas.repartition(spread)
    places = places.withColumn("_y", y("_lat")).withColumn("_x", x("_lon"))
    for name, code in (("lat", y), ("lon", x)):
        for end, step in (("min", 1), ("max", -1)):
            c = f"_{name}_{end}"
            areas = areas.withColumn(f"{c}_at", code(c))
            areas = areas.withColumn(f"{c}_in", F.col(f"{c}_at") + F.when(F.col(f"{c}_at") % 2 == 0, step).otherwise(0))

    def above(c: str) -> Column:
        return F.explode(F.array(*[F.shiftright(F.col(c) + (1 << depth), k) for k in range(depth + 1)]))

    sums = [F.sum("n").alias("n"), F.sum("_value").alias("_value")]
    cells = places.groupBy("_y", "_x").agg(F.count("*").alias("n"), F.sum("_value").alias("_value"))
    cells = cells.withColumn("_y", above("_y")).groupBy("_y", "_x").agg(*sums)
    cells = cells.withColumn("_x", above("_x")).groupBy("_y", "_x").agg(*sums)
    whole = areas.select(*by, F.explode(_covering(F.col("_lat_min_in"), F.col("_lat_max_in"), depth)).alias("_y"),
                         _covering(F.col("_lon_min_in"), F.col("_lon_max_in"), depth).alias("_x")).withColumn("_x", F.explode("_x"))
    # merged: the size of nodes is planned as that of the boxes, which may look small enough to broadcast
    parts = whole.hint("merge").join(cells, ["_y", "_x"]).select(*by, "n", "_value")

    width = 1 << depth       # strips so far apart that no cell of in_boxes holds two
    exact = F.col("_lat").between(F.col("_lat_min"), F.col("_lat_max")) & F.col("_lon").between(F.col("_lon_min"), F.col("_lon_max"))
    for across, along, strip, place, reach in (("lat", "lon", "_y", "_x", "at"), ("lon", "lat", "_x", "_y", "in")):
        cut = F.filter(F.array_distinct(F.array(f"_{across}_min_at", f"_{across}_max_at")), lambda c: c % 2 == 0)
        row = (F.col("_cut") * width).cast("double")
        edge = areas.select("*", F.explode(cut).alias("_cut")).select(
            *by, *[f"_{c}" for c in BOX_EDGES], row.alias("lat_min"), row.alias("lat_max"),
            F.col(f"_{along}_min_{reach}").cast("double").alias("lon_min"), F.col(f"_{along}_max_{reach}").cast("double").alias("lon_max"))
        near = places.select("_lat", "_lon", "_value", (F.col(strip) * width).alias("_strip"), F.col(place).alias("_place"))
        pairs = in_boxes(near, edge, "_strip", "_place", hot_rows).where(exact)
        parts = parts.unionByName(pairs.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_value").alias("_value")))
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("_value").alias("total"))


def obs_in_box(obs: DataFrame, stations: DataFrame, box, station: str = "station") -> DataFrame:
    """Observations whose station lies in the box: left semi join.

    The station dimension is counted before it is broadcast.
    """
    inside = within_bbox(stations, box).select(station)
    return obs.join(broadcast_checked(inside), station, "left_semi")


def resolve_station(points: DataFrame, stations: DataFrame, lat: str = "lat", lon: str = "lon",
                    strict: bool = True) -> DataFrame:
    """Coordinates -> station name by exact (lat, lon) match.

    An unknown coordinate raises (left join + ``raise_error``); with
    ``strict=False`` unknown points are dropped (inner join).
    """
    dim = stations.select(F.col("latitude").alias(lat), F.col("longitude").alias(lon), "station")
    if not strict:
        return points.join(broadcast_checked(dim), [lat, lon], "inner")
    j = points.join(broadcast_checked(dim), [lat, lon], "left")
    return j.withColumn("station", F.when(F.col("station").isNotNull(), F.col("station")).otherwise(
        F.raise_error(F.concat(F.lit("unknown coordinate "), F.col(lat).cast("string"), F.lit(" "),
                               F.col(lon).cast("string")))))


def with_threshold(df: DataFrame, pollutant: str = "pollutant", name: str = "threshold") -> DataFrame:
    """Safe-level threshold: exact name, else contains PM10, else PM2.5, else NULL.

    The lookup table is a literal, so it is an expression, not a join.
    """
    p = F.col(pollutant)
    table = dict(K.POLLUTANT_THRESHOLDS)
    expr = None
    for key, val in K.POLLUTANT_THRESHOLDS:
        cond = p == key
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    expr = expr.when(p.contains("PM10"), F.lit(table["PM10"])).when(p.contains("PM2.5"), F.lit(table["PM2.5"]))
    return df.withColumn(name, expr.otherwise(F.lit(None).cast("double")))


def series_grid(df: DataFrame, pollutant: str = "pollutant", station: str = "station") -> DataFrame:
    """Number of pollutants, stations and pollutant x station series.

    The product is counted, not materialised.
    """
    return df.agg(F.count_distinct(pollutant).alias("n_pollutants"),
                  F.count_distinct(station).alias("n_stations")).withColumn(
        "total_series", F.col("n_pollutants") * F.col("n_stations"))


def assign_chunks(obs: DataFrame, end, hours: int, n: int, ts: str = "ts") -> DataFrame:
    """Tag rows with the fetch chunk(s) they fall in.

    Chunk c covers [end - (c+1)h, end - c h], both ends inclusive, so a row on
    a border lands in two chunks.  The chunk number is computed, not joined:
    c = floor((end - ts) / h), plus c - 1 when the row sits exactly on a
    border.  Rows after ``end`` or before the oldest chunk are dropped.
    """
    end_col = ts_lit(end)
    h_us = F.lit(int(hours) * 3600 * 1_000_000)
    d = F.unix_micros(end_col.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    c = F.floor(d / h_us)
    on_border = (d == c * h_us) & (c >= 1)
    # candidates exploded, NULL (not on a border) dropped after: no lambda, so
    # ``end`` may itself be a scalar subquery
    cands = F.array(c.cast("int"), F.when(on_border, c - 1).cast("int"))
    out = obs.drop("chunk_no").withColumn("chunk_no", F.explode(cands))
    return out.where(F.col("chunk_no").isNotNull() & (d >= 0) & (F.col("chunk_no") < n)
                     & (F.col("chunk_no") >= 0))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def in_windows(rows: DataFrame, windows: DataFrame, ts: str = "ts", start: str = "start", end: str = "end",
               hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Every row with every window that holds its time, both ends inclusive
    (J9, S11, U1): the columns of ``rows``, then those of ``windows``.

    ``windows`` is a table of any size; lengths may differ, windows may overlap
    and leave gaps.  A window of length up to 2**k microseconds is filed under
    the cells of width 2**k that it touches, three at most; a row looks up one
    cell for each width in use (at most 63, read from the table), and the
    bounds are checked behind the equi-join.  A window fills at least a
    quarter of its cells, so few candidates fail the check whatever the
    lengths.  Cells with more than ``hot_rows`` rows are split by a hash of the
    row, and their windows copied to each part.  The plan does not grow with
    the windows.  Null times, null bounds and windows that end before they
    start match nothing; repeated rows and windows give repeated results.
    """
    clash = {c.lower() for c in rows.columns} & {c.lower() for c in windows.columns}
    if clash:
        raise ValueError(f"rows and windows share columns: {sorted(clash)}")
    a, b = _micros(F.col(start)), _micros(F.col(end))
    filed = windows.withColumn("_from", a).withColumn("_to", b).where(F.col("_from") <= F.col("_to"))
    filed = filed.withColumn("_level", F.ceil(F.log2((F.col("_to") - F.col("_from") + 1).cast("double"))).cast("int"))
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())
    keep = [F.col(f"`{c}`") for c in (*rows.columns, *windows.columns)]
    if not levels:
        return rows.join(windows, F.lit(False))

    def cell(x: Column) -> Column:
        return F.floor(x / F.expr("shiftleft(1L, _level)").cast("decimal(20,0)")).cast("long")

    filed = filed.withColumn("_cell", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to")))))
    looked = (rows.where(F.col(ts).isNotNull()).withColumn("_at", _micros(F.col(ts)))
              .withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]))).withColumn("_cell", cell(F.col("_at"))))
    hot = looked.groupBy("_level", "_cell").agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("_parts")).where("_parts > 1")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce("_parts", F.lit(1))).cast("int")
    left = looked.join(hot, ["_level", "_cell"], "left").withColumn("_part", part).drop("_parts")
    right = filed.join(hot, ["_level", "_cell"], "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return (left.join(right, ["_level", "_cell", "_part"])
            .where(F.col("_at").between(F.col("_from"), F.col("_to"))).select(*keep))


def chunk_windows(spark, end, hours: int, n: int) -> DataFrame:
    """``n`` back-to-back windows of ``hours`` ending at ``end``."""
    end_col = ts_lit(end)
    r = spark.range(n).select(F.col("id").cast("int").alias("chunk_no"))
    return r.select("chunk_no",
                    (end_col - F.make_dt_interval(F.lit(0), (F.col("chunk_no") + 1) * hours)).alias("start"),
                    (end_col - F.make_dt_interval(F.lit(0), F.col("chunk_no") * hours)).alias("end"))
