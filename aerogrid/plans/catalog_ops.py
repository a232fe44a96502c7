"""Registered queries for projections, joins, aggregates, windows, ordering
and scalar functions (SURVEY 2.2-2.7), each over whole driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.catalog import register
from aerogrid.functions import scalars as S
from aerogrid.operators import aggregates as A
from aerogrid.operators import joins as J
from aerogrid.operators import ordering as O
from aerogrid.operators import project as P
from aerogrid.operators import windows as W
from aerogrid.plans.catalog_core import dense, deduped, filled, recent
from aerogrid.plans.model import history, map_rows, station_snapshot
from aerogrid.plans.sqlparts import (DEDUP_SQL, FILLED_SQL, GRID_SQL, HIST_SQL, OBS_SQL, STATIONS_SQL,
                                     norm_sql, r6, wide_sql)
from aerogrid.session import cut_lineage
from aerogrid.sources.tables import table
from aerogrid.sources.testbed import load_obs, testbed_series, testbed_stations

T, N_STEPS = K.TRAINING_HOURS, K.N_STEPS
NO2, PM10L, PM25L = K.INDICATORS
CENTRE = K.REFERENCE_STATIONS[0][1:]   # box centre: first monitored station
BOX_KM = 10.0


def rnd(c, d: int = 6):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), d) + F.lit(0.0)


def hist(spark, sf_dir):
    return history(recent(spark, sf_dir), testbed_series())


# ---------------------------------------------------------------- 2.2 -------

@register("p1_select_indicators", f"""
SELECT station, indicator, ts, value FROM ({DEDUP_SQL}) d
WHERE indicator IN ('{NO2}', '{PM10L}')""")
def q_p1(spark, sf_dir):
    return P.select_indicators(deduped(spark, sf_dir), [NO2, PM10L]).select("station", "indicator", "ts", "value")


_MATTER_COLS = [f"{ind}_{s[0]}" for s in K.TESTBED_STATIONS for ind in K.INDICATORS if "matter" in ind]


@register("p2_select_matching",
          "SELECT ts, " + ", ".join(f'"{c}"' for c in _MATTER_COLS) + f" FROM ({wide_sql(FILLED_SQL)}) w")
def q_p2(spark, sf_dir):
    wide = A.to_wide(filled(spark, sf_dir), testbed_series())
    return P.select_matching(wide, ["matter"], keep=["ts"])


@register("p3_series_key", f"""
SELECT indicator || '_' || station AS series, ts, value FROM ({DEDUP_SQL}) d""")
def q_p3(spark, sf_dir):
    return deduped(spark, sf_dir).select(S.series_key("indicator", "station").alias("series"), "ts", "value")


@register("p4_nested_value", f"SELECT station, indicator, ts, value FROM ({OBS_SQL}) o")
def q_p4(spark, sf_dir):
    nested = load_obs(spark, sf_dir).select("station", "indicator", "ts", F.struct("value", "units").alias("m"))
    return nested.select("station", "indicator", "ts", P.nested_value("m").alias("value"))


@register("p5_coerce_ts", "SELECT event_id, ts FROM events")
def q_p5(spark, sf_dir):
    txt = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
                                               .alias("ts"))
    return P.coerce_ts(txt, "ts")


@register("p6_lenient_ts", "SELECT event_id, 'ts' AS src, ts FROM events")
def q_p6(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    both = ev.select("event_id", F.expr("stack(2, 'ts', date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), "
                                        "'props', props) AS (src, ts)"))
    return P.coerce_ts(both, "ts", lenient=True)


@register("p7_time_range", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate <= TIMESTAMP '1997-12-31 00:00:00'""")
def q_p7(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return P.time_range(li, "1996-01-01 00:00:00", "1997-12-31 00:00:00", "l_shipdate").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


@register("p8_bbox", f"""
SELECT station, {r6(f'latitude - {K.SQUARE_SIDE_KM} / {K.KM_PER_DEGREE}')} AS lat_min,
       {r6(f'latitude + {K.SQUARE_SIDE_KM} / {K.KM_PER_DEGREE}')} AS lat_max,
       {r6(f'longitude - {K.SQUARE_SIDE_KM} / ({K.KM_PER_DEGREE} * cos(radians(latitude)))')} AS lon_min,
       {r6(f'longitude + {K.SQUARE_SIDE_KM} / ({K.KM_PER_DEGREE} * cos(radians(latitude)))')} AS lon_max
FROM ({STATIONS_SQL}) s WHERE station IN (SELECT DISTINCT event_type FROM events)""")
def q_p8(spark, sf_dir):
    st = testbed_stations(spark).join(
        table(spark, sf_dir, "events").select(F.col("event_type").alias("station")).distinct(), "station", "left_semi")
    cols = J.bbox_columns("latitude", "longitude")
    return st.select("station", *cols).select(
        "station", *[rnd(n).alias(n) for n in ("lat_min", "lat_max", "lon_min", "lon_max")])


def _box_sql():
    lat_min, lat_max, lon_min, lon_max = J.bbox(*CENTRE, BOX_KM)
    return (f"latitude BETWEEN CAST({lat_min!r} AS DOUBLE) AND CAST({lat_max!r} AS DOUBLE) "
            f"AND longitude BETWEEN CAST({lon_min!r} AS DOUBLE) AND CAST({lon_max!r} AS DOUBLE)")


@register("p9_within_bbox", f"""
SELECT station, fmisid, latitude, longitude FROM ({STATIONS_SQL}) s
WHERE station IN (SELECT DISTINCT event_type FROM events) AND {_box_sql()}""")
def q_p9(spark, sf_dir):
    st = testbed_stations(spark).join(
        table(spark, sf_dir, "events").select(F.col("event_type").alias("station")).distinct(), "station", "left_semi")
    return J.within_bbox(st, J.bbox(*CENTRE, BOX_KM))


@register("p10_lookback", f"""
WITH d AS ({DEDUP_SQL}), l AS (SELECT station, max(ts) AS end_ts FROM d GROUP BY station)
SELECT d.station, d.indicator, d.ts, d.value FROM d JOIN l ON d.station = l.station
WHERE d.ts >= l.end_ts - INTERVAL {K.AIR_LOOKBACK_MINUTES} MINUTE AND d.ts <= l.end_ts""")
def q_p10(spark, sf_dir):
    d = deduped(spark, sf_dir)
    # duplicates share their time, so the last one needs no dedup: a partial maximum per station
    ends = load_obs(spark, sf_dir).groupBy("station").agg(F.max("ts").alias("end_ts"))
    start, end = P.lookback(F.col("end_ts"), None, K.AIR_LOOKBACK_MINUTES)
    win = ends.select("station", start.alias("start_ts"), end.alias("end_ts"))
    j = d.join(win, "station")
    return j.where(F.col("ts").between(F.col("start_ts"), F.col("end_ts"))).select(
        "station", "indicator", "ts", "value")


@register("p11_equality_filter", f"""
SELECT station, indicator, ts, value FROM ({FILLED_SQL}) f
WHERE station = 'click' AND indicator = '{NO2}'""")
def q_p11(spark, sf_dir):
    return P.where_equal(filled(spark, sf_dir), station="click", indicator=NO2).select(
        "station", "indicator", "ts", "value")


@register("p12_numeric_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem""")
def q_p12(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*P.numeric_columns(li))


@register("p13_localize", """
SELECT event_id, CAST(timezone('UTC', timezone('Europe/Helsinki', ts)) AS TIMESTAMP) AS ts_utc FROM events""")
def q_p13(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    return P.localize(ev, "ts", "Europe/Helsinki", name="ts_utc").select(
        "event_id", F.col("ts_utc").cast("timestamp_ntz").alias("ts_utc"))


@register("p14_sufficiency", f"""
SELECT station, count(DISTINCT ts) AS n_rows, {T + N_STEPS + K.TRAIN_EXTRA_ROWS} AS min_required,
       count(DISTINCT ts) >= {T + N_STEPS + K.TRAIN_EXTRA_ROWS} AS sufficient
FROM ({DEDUP_SQL}) d GROUP BY station""")
def q_p14(spark, sf_dir):
    need = T + N_STEPS + K.TRAIN_EXTRA_ROWS
    return P.sufficiency(deduped(spark, sf_dir).select("station", "ts").distinct(), need, by=["station"])


P15_TABLES = ["customer", "documents", "events", "lineitem", "orders", "pages"]


@register("p15_nonempty_gate", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) > 0 AS passes FROM {t}" for t in P15_TABLES)
    + " UNION ALL SELECT 'events after the last', false")
def q_p15(spark, sf_dir):
    """What the gate says of whole tables, and of one filter that nothing passes."""
    sets = {t: table(spark, sf_dir, t) for t in P15_TABLES}
    ev = sets["events"]
    sets["events after the last"] = ev.where(F.col("ts") > ev.agg(F.max("ts")).scalar())

    def passes(df):
        try:
            P.require_nonempty(df)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(t, passes(df)) for t, df in sets.items()], "dataset string, passes boolean")


# ---------------------------------------------------------------- 2.3 -------

@register("j1_full_outer_merge", f"""
WITH o AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day, count(*) AS n_orders,
                  {r6('sum(o_totalprice)')} AS order_value FROM orders GROUP BY 1),
     l AS (SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS day, count(*) AS n_lines,
                  {r6('sum(l_quantity)')} AS shipped_qty FROM lineitem GROUP BY 1)
SELECT * FROM o FULL OUTER JOIN l USING (day)""")
def q_j1(spark, sf_dir):
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz").alias("day")
    o = table(spark, sf_dir, "orders").groupBy(day("o_orderdate")).agg(
        F.count(F.lit(1)).alias("n_orders"), rnd(F.sum("o_totalprice")).alias("order_value"))
    li = table(spark, sf_dir, "lineitem").groupBy(day("l_shipdate")).agg(
        F.count(F.lit(1)).alias("n_lines"), rnd(F.sum("l_quantity")).alias("shipped_qty"))
    return J.merge_on(o, li, "day")


def _station_frames(spark, sf_dir):
    d = cut_lineage(deduped(spark, sf_dir).select("station", "indicator", "ts", "value"))
    frames = []
    for s, *_ in K.TESTBED_STATIONS:
        w = d.where(F.col("station") == s).groupBy("ts").pivot("indicator", K.INDICATORS).agg(F.first("value"))
        frames.append(w.select("ts", *[F.col(f"`{ind}`").alias(f"{ind}_{s}") for ind in K.INDICATORS]))
    return frames


def _merge_stations_sql():
    parts = []
    for s, *_ in K.TESTBED_STATIONS:
        cols = ", ".join(f"max(CASE WHEN indicator = '{ind}' THEN value END) AS \"{ind}_{s}\"" for ind in K.INDICATORS)
        parts.append(f"(SELECT ts, {cols} FROM ({DEDUP_SQL}) d WHERE station = '{s}' GROUP BY ts)")
    sql = parts[0] + " s0"
    for i, p in enumerate(parts[1:], 1):
        sql += f" FULL OUTER JOIN {p} s{i} USING (ts)"
    return "SELECT * FROM " + sql


@register("j1_merge_stations", _merge_stations_sql())
def q_j1b(spark, sf_dir):
    return J.merge_unique(_station_frames(spark, sf_dir), "ts")


@register("j2_obs_in_box", f"""
SELECT station, indicator, ts, value FROM ({DEDUP_SQL}) d
WHERE station IN (SELECT station FROM ({STATIONS_SQL}) s WHERE {_box_sql()})""")
def q_j2(spark, sf_dir):
    d = deduped(spark, sf_dir).select("station", "indicator", "ts", "value")
    return J.obs_in_box(d, testbed_stations(spark), J.bbox(*CENTRE, BOX_KM))


@register("j6_with_threshold", f"""
SELECT pollutant, station, hour, timestamp, value,
       CAST(CASE WHEN pollutant = 'Nitrogen dioxide' THEN 10.0 WHEN pollutant = 'PM10' THEN 15.0
            WHEN pollutant = 'PM2.5' THEN 5.0 WHEN contains(pollutant, 'PM10') THEN 15.0
            WHEN contains(pollutant, 'PM2.5') THEN 5.0 END AS DOUBLE) AS threshold
FROM ({HIST_SQL}) h""")
def q_j6(spark, sf_dir):
    return J.with_threshold(hist(spark, sf_dir).drop("feature"))


@register("j8_series_grid", f"""
SELECT count(DISTINCT pollutant) AS n_pollutants, count(DISTINCT station) AS n_stations,
       count(DISTINCT pollutant) * count(DISTINCT station) AS total_series FROM ({HIST_SQL}) h""")
def q_j8(spark, sf_dir):
    return J.series_grid(hist(spark, sf_dir))


#: As many chunks as reach back to the first observation.
N_CHUNKS_SQL = f"""(SELECT CAST(floor(epoch(max(ts) - min(ts)) / {K.CHUNK_HOURS * 3600}) AS BIGINT) + 1 FROM
   (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts FROM events) h)"""


def n_chunks(obs) -> int:
    first, last = obs.agg(F.min("ts"), F.max("ts")).first()
    return int((last - first).total_seconds() // (K.CHUNK_HOURS * 3600)) + 1 if last else 0


@register("j9_assign_chunks", f"""
WITH d AS ({DEDUP_SQL}), e AS (SELECT max(ts) AS end_ts FROM d),
     c AS (SELECT CAST(i AS INTEGER) AS chunk_no,
                  end_ts - to_hours(CAST(({K.CHUNK_HOURS} * (i + 1)) AS BIGINT)) AS c_start,
                  end_ts - to_hours(CAST(({K.CHUNK_HOURS} * i) AS BIGINT)) AS c_end
           FROM (SELECT unnest(range({N_CHUNKS_SQL})) AS i) r, e)
SELECT d.station, d.indicator, d.ts, d.value, c.chunk_no FROM d JOIN c ON d.ts BETWEEN c.c_start AND c.c_end""")
def q_j9(spark, sf_dir):
    d = deduped(spark, sf_dir).select("station", "indicator", "ts", "value")
    return J.in_windows(d, _chunks(spark, sf_dir)).drop("start", "end")


def _station_days(obs):
    """Windows that differ in length, overlap and leave gaps: from the first to
    the last observation of a station on each day."""
    return obs.groupBy(F.col("station").alias("window_station"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"))


@register("j9_windows_from_table", f"""
WITH d AS ({DEDUP_SQL}),
     w AS (SELECT station AS window_station, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, min(ts) AS start, max(ts) AS "end"
           FROM d GROUP BY 1, 2)
SELECT w.window_station, w.day, w.start, w."end", count(*) AS n_rows, count(DISTINCT d.station) AS n_stations,
       {r6('avg(d.value)')} AS mean_value
FROM d JOIN w ON d.ts BETWEEN w.start AND w."end" GROUP BY 1, 2, 3, 4""")
def q_j9_table(spark, sf_dir):
    d = cut_lineage(deduped(spark, sf_dir).select("station", "ts", "value"))
    return J.in_windows(d, cut_lineage(_station_days(d))).groupBy("window_station", "day", "start", "end").agg(
        F.count("*").alias("n_rows"), F.count_distinct("station").alias("n_stations"), rnd(F.avg("value")).alias("mean_value"))


@register("s11_chunk_windows", f"""
WITH e AS (SELECT max(CAST(date_trunc('hour', ts) AS TIMESTAMP)) AS end_ts FROM events)
SELECT CAST(i AS INTEGER) AS chunk_no, end_ts - to_hours(CAST(({K.CHUNK_HOURS} * (i + 1)) AS BIGINT)) AS start,
       end_ts - to_hours(CAST(({K.CHUNK_HOURS} * i) AS BIGINT)) AS "end"
FROM (SELECT unnest(range({N_CHUNKS_SQL})) AS i) r, e""")
def q_s11(spark, sf_dir):
    return _chunks(spark, sf_dir)


def _chunks(spark, sf_dir):
    """The fetch windows as a table, back from the last observation to the first."""
    obs = load_obs(spark, sf_dir)
    end = obs.select(F.max("ts")).first()[0]   # one scalar parameter
    return J.chunk_windows(spark, end, K.CHUNK_HOURS, n_chunks(obs))


# ---------------------------------------------------------------- 2.4 -------

@register("a2_dedup_station_ts", f"""
SELECT station, ts, indicator, value, seq FROM ({OBS_SQL}) o
QUALIFY row_number() OVER (PARTITION BY station, ts ORDER BY chunk_no, seq) = 1""")
def q_a2(spark, sf_dir):
    o = load_obs(spark, sf_dir).select("station", "ts", "indicator", "value", "chunk_no", "seq")
    return A.dedup_first(o, ["station", "ts"]).drop("chunk_no")


@register("a3_dedup_last", f"""
SELECT station, indicator, ts, value, seq FROM ({OBS_SQL}) o
QUALIFY row_number() OVER (PARTITION BY station, indicator, ts ORDER BY seq DESC) = 1""")
def q_a3(spark, sf_dir):
    o = load_obs(spark, sf_dir).select("station", "indicator", "ts", "value", "seq")
    return A.dedup_last(o, ["station", "indicator", "ts"], ["seq"])


@register("a4_collect_by_station", f"""
SELECT station, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
       CAST(row_number() OVER (PARTITION BY station, date_trunc('day', ts) ORDER BY ts, indicator, seq) - 1
            AS INTEGER) AS pos, ts, indicator, value
FROM ({DEDUP_SQL}) d""")
def q_a4(spark, sf_dir):
    d = deduped(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    keyed = d.withColumn("station_day", F.struct("station", "day"))
    c = A.collect_by_key(keyed, "station_day", "ts", ["indicator", "seq", "value"])
    ex = c.select("station_day", F.posexplode("rows").alias("pos", "r"))
    return ex.select(F.col("station_day.station").alias("station"), F.col("station_day.day").alias("day"),
                     "pos", "r.ts", "r.indicator", "r.value")


@register("a5_profile", f"""
SELECT count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts, 7 AS n_columns FROM ({OBS_SQL}) o""")
def q_a5(spark, sf_dir):
    return A.profile(load_obs(spark, sf_dir))


@register("a6_shape", f"""
SELECT count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts,
       {1 + len(K.TESTBED_STATIONS) * len(K.INDICATORS)} AS n_columns FROM ({wide_sql(FILLED_SQL)}) w""")
def q_a6(spark, sf_dir):
    return A.profile(A.to_wide(filled(spark, sf_dir), testbed_series()))


@register("a9_history_summary", f"""
SELECT pollutant, station, {r6('round(avg(value), 1)')} AS avg_predicted, {r6('round(max(value), 1)')} AS max_predicted,
       {r6('round(min(value), 1)')} AS min_predicted FROM ({HIST_SQL}) h GROUP BY pollutant, station""")
def q_a9h(spark, sf_dir):
    s = A.forecast_summary(hist(spark, sf_dir))
    return s.select("pollutant", "station", *[rnd(c).alias(c) for c in
                                              ("avg_predicted", "max_predicted", "min_predicted")])


def _snapshot(spark, sf_dir):
    return station_snapshot(hist(spark, sf_dir), testbed_stations(spark))


SNAP_SQL = f"""
WITH h AS ({HIST_SQL}), l AS (SELECT * FROM h WHERE timestamp = (SELECT max(timestamp) FROM h)),
     w AS (SELECT station, max(timestamp) AS timestamp,
                  max(CASE WHEN pollutant = 'Nitrogen dioxide' THEN value END) AS no2,
                  max(CASE WHEN pollutant = 'PM10' THEN value END) AS pm10,
                  max(CASE WHEN pollutant = 'PM2.5' THEN value END) AS pm25 FROM l GROUP BY station)
SELECT s.station, s.latitude, s.longitude, w.timestamp, w.no2, w.pm10, w.pm25
FROM ({STATIONS_SQL}) s LEFT JOIN w ON s.station = w.station"""


@register("a11_network_mean", f"""
SELECT {r6('avg(coalesce(pm10, 0.0))')} AS avg_value, count(*) AS n_stations FROM ({SNAP_SQL}) s""")
def q_a11(spark, sf_dir):
    r = A.network_mean(_snapshot(spark, sf_dir), "pm10", 0.0)
    return r.select(rnd("avg_value").alias("avg_value"), "n_stations")


@register("a12_forecast_labels", f"""
SELECT coalesce(nullif(string_agg(DISTINCT pollutant, ', ' ORDER BY pollutant), ''), 'N/A') AS pollutants,
       coalesce(nullif(string_agg(DISTINCT station, ', ' ORDER BY station), ''), 'N/A') AS stations
FROM ({HIST_SQL}) h""")
def q_a12(spark, sf_dir):
    h = hist(spark, sf_dir)
    return h.agg(A.label_list(h, "pollutant").alias("pollutants"), A.label_list(h, "station").alias("stations"))


# ---------------------------------------------------------------- 2.5 -------

_PER_STATION_SQL = f"""
SELECT station, ts, max(CASE WHEN indicator = '{NO2}' THEN value END) AS no2,
       max(CASE WHEN indicator = '{PM10L}' THEN value END) AS pm10,
       max(CASE WHEN indicator = '{PM25L}' THEN value END) AS pm25
FROM ({DEDUP_SQL}) d GROUP BY station, ts"""


@register("w3_ffill_table", f"""
SELECT station, ts,
       last_value(no2 IGNORE NULLS) OVER w AS no2, last_value(pm10 IGNORE NULLS) OVER w AS pm10,
       last_value(pm25 IGNORE NULLS) OVER w AS pm25
FROM ({_PER_STATION_SQL}) p
WINDOW w AS (ORDER BY ts, station ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_w3(spark, sf_dir):
    d = deduped(spark, sf_dir)
    per = d.groupBy("station", "ts").pivot("indicator", K.INDICATORS).agg(F.first("value")).select(
        "station", "ts", F.col(f"`{NO2}`").alias("no2"), F.col(f"`{PM10L}`").alias("pm10"),
        F.col(f"`{PM25L}`").alias("pm25"))
    return W.ffill_table(per, P.numeric_columns(per), "ts", tiebreak=["station"])


def _indexed_long(spark, sf_dir):
    f = filled(spark, sf_dir)
    idx = W.dense_index(f, "ts")
    return f.join(idx, "ts")


@register("w4_lag_window", f"""
WITH l AS (SELECT station, indicator, ts,
                  list(value) OVER (PARTITION BY station, indicator ORDER BY ts
                                    ROWS BETWEEN {T} PRECEDING AND 1 PRECEDING) AS lag
           FROM ({FILLED_SQL}) f)
SELECT station, indicator, ts, CAST(unnest(range({T})) AS INTEGER) AS lag_pos, unnest(lag) AS lag_value
FROM l WHERE len(lag) = {T}""")
def q_w4(spark, sf_dir):
    a = W.window_arrays(_indexed_long(spark, sf_dir), ["station", "indicator"], "idx", ["value"],
                        before=T, after=0)
    return a.select("station", "indicator", "ts", F.posexplode("lag").alias("lag_pos", "p")).select(
        "station", "indicator", "ts", "lag_pos", F.col("p.value").alias("lag_value"))


@register("w5_lead_window", f"""
WITH l AS (SELECT station, indicator, ts,
                  list(value) OVER (PARTITION BY station, indicator ORDER BY ts
                                    ROWS BETWEEN CURRENT ROW AND {N_STEPS - 1} FOLLOWING) AS lead
           FROM ({FILLED_SQL}) f)
SELECT station, indicator, ts, CAST(unnest(range({N_STEPS})) AS INTEGER) AS lead_pos, unnest(lead) AS lead_value
FROM l WHERE len(lead) = {N_STEPS}""")
def q_w5(spark, sf_dir):
    a = W.window_arrays(_indexed_long(spark, sf_dir), ["station", "indicator"], "idx", ["value"],
                        before=0, after=N_STEPS)
    return a.select("station", "indicator", "ts", F.posexplode("lead").alias("lead_pos", "p")).select(
        "station", "indicator", "ts", "lead_pos", F.col("p.value").alias("lead_value"))


@register("w6_latest_window", f"""
SELECT station, indicator, ts, value FROM ({FILLED_SQL}) f
QUALIFY row_number() OVER (PARTITION BY station, indicator ORDER BY ts DESC) <= {T}""")
def q_w6(spark, sf_dir):
    f = filled(spark, sf_dir).select("station", "indicator", "ts", "value")
    return W.tail_per_key(f, ["station", "indicator"], "ts", T)


@register("w7_latest_per_station", f"""
SELECT station, indicator, ts, value, seq FROM ({DEDUP_SQL}) d
QUALIFY row_number() OVER (PARTITION BY station ORDER BY ts DESC, seq DESC) = 1""")
def q_w7(spark, sf_dir):
    d = deduped(spark, sf_dir).select("station", "indicator", "ts", "value", "seq")
    return W.latest_per_key(d, ["station"], ["ts", "seq"])


@register("w8_rows_at_latest", f"""
SELECT station, indicator, ts, value FROM ({DEDUP_SQL}) d WHERE ts = (SELECT max(ts) FROM ({DEDUP_SQL}) d2)""")
def q_w8(spark, sf_dir):
    return W.rows_at_latest(deduped(spark, sf_dir).select("station", "indicator", "ts", "value"))


@register("w9_dense_index", f"""
SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx FROM (SELECT DISTINCT ts FROM ({GRID_SQL}) g) d""")
def q_w9(spark, sf_dir):
    return W.dense_index(dense(spark, sf_dir), "ts")


# ---------------------------------------------------------------- 2.6 -------

@register("o1_sort_by_time", f"SELECT station, indicator, ts, value FROM ({DEDUP_SQL}) d ORDER BY ts")
def q_o1(spark, sf_dir):
    return O.sort_by_time(deduped(spark, sf_dir).select("station", "indicator", "ts", "value"))


@register("o2_tail_rows", f"SELECT * FROM ({wide_sql(FILLED_SQL)}) w ORDER BY ts DESC LIMIT {T + N_STEPS}")
def q_o2(spark, sf_dir):
    return O.tail_rows(A.to_wide(filled(spark, sf_dir), testbed_series()), T + N_STEPS)


@register("o3_order_labels", f"""
SELECT DISTINCT pollutant, station FROM ({HIST_SQL}) h ORDER BY pollutant DESC, station""")
def q_o3(spark, sf_dir):
    return O.order_labels(hist(spark, sf_dir).select("pollutant", "station").distinct())


@register("u1_union_chunks", f"""
WITH d AS ({OBS_SQL}), e AS (SELECT max(ts) AS end_ts FROM d),
     c AS (SELECT CAST(i AS INTEGER) AS chunk_no,
                  end_ts - to_hours(CAST(({K.CHUNK_HOURS} * (i + 1)) AS BIGINT)) AS c_start,
                  end_ts - to_hours(CAST(({K.CHUNK_HOURS} * i) AS BIGINT)) AS c_end
           FROM (SELECT unnest(range({N_CHUNKS_SQL})) AS i) r, e)
SELECT d.station, d.indicator, d.ts, d.value, c.chunk_no
FROM d JOIN c ON d.ts BETWEEN c.c_start AND c.c_end
QUALIFY row_number() OVER (PARTITION BY d.station, d.indicator, d.ts ORDER BY c.chunk_no, d.seq) = 1""")
def q_u1(spark, sf_dir):
    o = load_obs(spark, sf_dir).select("station", "indicator", "ts", "value", "seq")
    return O.union_windows(o, _chunks(spark, sf_dir)).drop("seq")


@register("u1_union_windows_from_table", f"""
WITH d AS ({OBS_SQL}),
     w AS (SELECT row_number() OVER (ORDER BY day DESC, station) AS chunk_no, start, "end" FROM
           (SELECT station, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, min(ts) AS start, max(ts) AS "end" FROM d GROUP BY 1, 2) g)
SELECT d.station, d.indicator, d.ts, d.value, d.seq, w.chunk_no FROM d JOIN w ON d.ts BETWEEN w.start AND w."end"
QUALIFY row_number() OVER (PARTITION BY d.station, d.indicator, d.ts ORDER BY w.chunk_no, d.seq) = 1""")
def q_u1_table(spark, sf_dir):
    """Windows by day and station, newest first: each row is kept once, with the newest window that holds it."""
    o = load_obs(spark, sf_dir).select("station", "indicator", "ts", "value", "seq")
    newest = Window.orderBy(F.col("day").desc(), "window_station")   # one row per station and day
    w = cut_lineage(_station_days(o)).withColumn("chunk_no", F.row_number().over(newest).cast("long"))
    return O.union_windows(o, w.select("chunk_no", "start", "end"))


@register("u2_label_union", f"""
SELECT pollutant FROM ({HIST_SQL}) h UNION SELECT {norm_sql('indicator')} AS pollutant FROM ({OBS_SQL}) o""")
def q_u2(spark, sf_dir):
    obs = load_obs(spark, sf_dir).select(S.normalise_pollutant("indicator").alias("pollutant"))
    return O.label_union(hist(spark, sf_dir), obs, "pollutant")


# ---------------------------------------------------------------- 2.7 -------

@register("f1_cyclic_features", f"""
SELECT ts, {r6('sin(2 * pi() * hour(ts) / 24.0)')} AS hour_sin, {r6('cos(2 * pi() * hour(ts) / 24.0)')} AS hour_cos,
       {r6('sin(2 * pi() * (isodow(ts) - 1) / 7.0)')} AS day_sin, {r6('cos(2 * pi() * (isodow(ts) - 1) / 7.0)')} AS day_cos
FROM (SELECT DISTINCT ts FROM ({GRID_SQL}) g) d""")
def q_f1(spark, sf_dir):
    d = dense(spark, sf_dir).select("ts").distinct()
    feats = S.cyclic_time_features("ts")
    return d.select("ts", *[rnd(c).alias(n) for c, n in zip(feats, K.TIME_FEATURES)])


@register("f2_hour_weekday", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, isodow(ts) - 1 AS weekday FROM events")
def q_f2(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", S.hour_of("ts").alias("hour"), S.weekday_of("ts").cast("bigint").alias("weekday"))


@register("f3_split_key", f"""
SELECT k AS key, CASE WHEN contains(k, '_') THEN split_part(k, '_', 1) ELSE k END AS pollutant,
       CASE WHEN contains(k, '_') THEN substr(k, strpos(k, '_') + 1) ELSE '{K.UNKNOWN_STATION}' END AS station
FROM (SELECT pollutant || '_' || station AS k FROM ({HIST_SQL}) h UNION ALL SELECT c_name AS k FROM customer) u""")
def q_f3(spark, sf_dir):
    keys = hist(spark, sf_dir).select(F.concat_ws("_", "pollutant", "station").alias("key")).unionByName(
        table(spark, sf_dir, "customer").select(F.col("c_name").alias("key")))
    return keys.select("key", S.key_pollutant("key").alias("pollutant"), S.key_station("key").alias("station"))


@register("f4_normalise", f"SELECT DISTINCT indicator, {norm_sql('indicator')} AS pollutant FROM ({OBS_SQL}) o")
def q_f4(spark, sf_dir):
    return load_obs(spark, sf_dir).select("indicator", S.normalise_pollutant("indicator").alias("pollutant")).distinct()


@register("f5_forecast_key", f"""
SELECT DISTINCT indicator || '_' || station AS feature, {norm_sql('indicator')} || '_' || station AS key
FROM ({OBS_SQL}) o""")
def q_f5(spark, sf_dir):
    o = load_obs(spark, sf_dir).select(S.series_key("indicator", "station").alias("feature")).distinct()
    return o.select("feature", S.forecast_key("feature").alias("key"))


@register("f6_f7_f8_time_labels", f"""
SELECT event_id, 'hour_' || CAST(hour(ts) + 1 AS VARCHAR) AS hour_label,
       ts + INTERVAL {N_STEPS} HOUR AS ts_plus,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso_z
FROM events""")
def q_f678(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", S.hour_label(S.hour_of("ts") + 1).alias("hour_label"),
                     S.add_hours("ts", F.lit(N_STEPS)).alias("ts_plus"), S.iso_z("ts").alias("iso_z"))


@register("f9_f10_epoch", """
SELECT event_id, make_timestamp(epoch_us(ts)) AS ts_from_seconds,
       strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M') AS ms_text
FROM events""")
def q_f910(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return ev.select("event_id", S.epoch_seconds_to_ts(secs).alias("ts_from_seconds"),
                     S.epoch_millis_text(ms).alias("ms_text"))


@register("f18_from_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q_f18(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@register("f19_pm10_colour", """
SELECT event_id, CASE WHEN value > 50 THEN 'red' WHEN value > 30 THEN 'orange'
                      WHEN value > 20 THEN 'yellow' ELSE 'green' END AS colour FROM events""")
def q_f19(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", S.pm10_colour("value").alias("colour"))


@register("f20_r2_band", """
SELECT event_id, CASE WHEN value / 100.0 > 0.8 THEN 'excellent' WHEN value / 100.0 > 0.6 THEN 'good'
                      WHEN value / 100.0 > 0.4 THEN 'fair' ELSE 'poor' END AS band FROM events""")
def q_f20(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", S.r2_band(F.col("value") / 100.0).alias("band"))


@register("f22_short_run_id", """
SELECT c_custkey, CASE WHEN length(c_name) > 8 THEN substr(c_name, 1, 8) || '...' ELSE c_name END AS short_id
FROM customer""")
def q_f22(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.short_run_id("c_name").alias("short_id"))


@register("f23_number_format", """
SELECT l_orderkey, l_linenumber, printf('%.3f', l_extendedprice) AS price_text,
       printf('%+.3f', l_extendedprice - l_quantity) AS delta_text FROM lineitem""")
def q_f23(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.fixed("l_extendedprice", 3).alias("price_text"),
                     S.signed(F.col("l_extendedprice") - F.col("l_quantity"), 3).alias("delta_text"))


@register("f24_age_hours", f"""
SELECT event_id, {r6('(epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 3600000000.0')} AS age_hours
FROM events""")
def q_f24(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", rnd(S.age_hours(ev.select(F.max("ts")).scalar(), F.col("ts"))).alias("age_hours"))


@register("f25_defaults", f"""
SELECT station, indicator, ts,
       coalesce(value, CASE indicator WHEN '{NO2}' THEN {K.MAP_DEFAULT_NO2} WHEN '{PM10L}' THEN {K.MAP_DEFAULT_PM10}
                                      ELSE {K.MAP_DEFAULT_PM25} END) AS value
FROM ({GRID_SQL}) g""")
def q_f25(spark, sf_dir):
    g = dense(spark, sf_dir)
    default = (F.when(F.col("indicator") == NO2, K.MAP_DEFAULT_NO2)
               .when(F.col("indicator") == PM10L, K.MAP_DEFAULT_PM10).otherwise(K.MAP_DEFAULT_PM25))
    return g.select("station", "indicator", "ts", F.coalesce("value", default).alias("value"))


# ------------------------------------------------------- snapshot views ------

@register("m12_history", HIST_SQL)
def q_m12(spark, sf_dir):
    return hist(spark, sf_dir)


@register("m15_station_snapshot", SNAP_SQL)
def q_m15(spark, sf_dir):
    return _snapshot(spark, sf_dir)


@register("m13_map_rows", f"""
SELECT station, latitude, longitude, timestamp, coalesce(pm10, {K.MAP_DEFAULT_PM10}) AS pm10,
       coalesce(pm25, {K.MAP_DEFAULT_PM25}) AS pm25, coalesce(no2, {K.MAP_DEFAULT_NO2}) AS no2,
       CASE WHEN coalesce(pm10, {K.MAP_DEFAULT_PM10}) > 50 THEN 'red'
            WHEN coalesce(pm10, {K.MAP_DEFAULT_PM10}) > 30 THEN 'orange'
            WHEN coalesce(pm10, {K.MAP_DEFAULT_PM10}) > 20 THEN 'yellow' ELSE 'green' END AS colour,
       30 AS size
FROM ({SNAP_SQL}) s""")
def q_m13(spark, sf_dir):
    return map_rows(_snapshot(spark, sf_dir))
