"""Edge fixtures: fills, dedup order, grid, keys, colours, registry, DST,
document decode."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerogrid.functions import scalars as S
from aerogrid.operators.aggregates import compare_means, dedup_first, dedup_last
from aerogrid.operators.joins import assign_chunks, densify
from aerogrid.operators.project import coerce_ts, localize
from aerogrid.operators.windows import fill_gaps, require_no_empty_series, window_arrays
from aerogrid.plans.registry import resolve_model, resolve_model_row
from aerogrid.sources import multipoint as MP
from aerogrid.sources.tables import read_table

H = dt.timedelta(hours=1)
T0 = dt.datetime(2024, 1, 1)


def _series(spark, values, start=T0, step=H):
    rows = [("A", "x", start + i * step, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station string, indicator string, ts timestamp_ntz, value double")


def _filled(df):
    return [r.value for r in fill_gaps(df).orderBy("ts").collect()]


def test_nan_gap(spark):
    df = _series(spark, [1.0, float("nan"), 3.0]).withColumn("value", F.nanvl("value", F.lit(None)))
    assert _filled(df) == [1.0, 1.0, 3.0]


def test_leading_gap(spark):
    assert _filled(_series(spark, [None, None, 5.0, None])) == [5.0, 5.0, 5.0, 5.0]


def test_fill_across_blocks(spark):
    # 40 days hourly: gaps crossing many week blocks are carried
    vals = [None] * (24 * 40)
    vals[30] = 7.0
    vals[24 * 20] = 9.0
    out = _filled(_series(spark, vals))
    assert out[:31] == [7.0] * 31
    assert out[24 * 19] == 7.0 and out[24 * 20] == 9.0 and out[-1] == 9.0


def test_all_null_series_raises(spark):
    df = _series(spark, [None, None], ).withColumn("value", F.col("value").cast("double"))
    with pytest.raises(ValueError, match="A_x"):
        require_no_empty_series(fill_gaps(df))


def test_chunk_edge_keeps_newest(spark):
    rows = [("A", "x", T0, 7.0, 0, 5), ("A", "x", T0, 9.0, 1, 1)]
    df = spark.createDataFrame(rows, "station string, indicator string, ts timestamp_ntz, value double, "
                                     "chunk_no int, seq bigint")
    assert dedup_first(df, ["station", "indicator", "ts"]).first().value == 7.0
    assert dedup_last(df, ["station", "indicator", "ts"], ["seq"]).first().value == 7.0


def test_uneven_times_grid(spark):
    rows = [("A", "x", T0, 1.0), ("A", "x", T0 + H, 2.0), ("B", "x", T0 + H, 3.0), ("B", "x", T0 + 2 * H, 4.0)]
    df = spark.createDataFrame(rows, "station string, indicator string, ts timestamp_ntz, value double")
    g = densify(df, [("A", "x"), ("B", "x")])
    assert g.count() == 6
    assert g.where("value IS NULL").count() == 2
    f = {(r.station, r.ts): r.value for r in fill_gaps(g).collect()}
    assert f[("A", T0 + 2 * H)] == 2.0 and f[("B", T0)] == 3.0


def test_assign_chunks_border_row_in_two(spark):
    end = dt.datetime(2024, 1, 15)
    rows = [("A", "x", end - dt.timedelta(hours=168), 1.0), ("A", "x", end - H, 2.0)]
    df = spark.createDataFrame(rows, "station string, indicator string, ts timestamp_ntz, value double")
    got = sorted((r.value, r.chunk_no) for r in assign_chunks(df, end, 168, 2).collect())
    assert got == [(1.0, 0), (1.0, 1), (2.0, 0)]


def test_window_arrays_across_blocks(spark):
    rows = [("A", i, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "station string, idx long, v double")
    a = window_arrays(df, ["station"], "idx", ["v"], before=3, after=2, block_rows=8).orderBy("idx").collect()
    assert [r.idx for r in a] == list(range(3, 49))
    r = [x for x in a if x.idx == 16][0]
    assert [p.v for p in r.lag] == [13.0, 14.0, 15.0] and [p.v for p in r.lead] == [16.0, 17.0]


def test_bad_timestamp_dropped(spark):
    df = spark.createDataFrame([("garbage",), ("2024-01-01T05:00:00",)], "ts string")
    out = coerce_ts(df, "ts", lenient=True).collect()
    assert [r.ts for r in out] == [dt.datetime(2024, 1, 1, 5, 0)]


def test_key_split(spark):
    df = spark.createDataFrame([("PM10_a_b",), ("PM10",)], "k string")
    out = df.select(S.key_pollutant("k").alias("p"), S.key_station("k").alias("s")).collect()
    assert [(r.p, r.s) for r in out] == [("PM10", "a_b"), ("PM10", "Unknown Station")]


def test_colour_bands(spark):
    df = spark.createDataFrame([(50.1,), (50.0,), (30.0,), (20.0,), (None,), (float("nan"),)], "v double")
    assert [r.c for r in df.select(S.pm10_colour("v").alias("c")).collect()] == \
        ["red", "orange", "yellow", "green", "green", "green"]


def test_hist_zero_change_pct(spark):
    pred = spark.createDataFrame([("NO2", 5.0)], "pollutant string, value double")
    hist = spark.createDataFrame([("NO2", 0.0)], "pollutant string, value double")
    r = compare_means(pred, hist).first()
    assert r.change == 5.0 and r.change_pct == 0.0


def test_r2_constant_target(spark):
    from aerogrid.operators.aggregates import regression_metrics
    exact = spark.createDataFrame([(0, 2.0, 2.0), (0, 2.0, 2.0)], "target int, y double, yhat double")
    off = spark.createDataFrame([(0, 2.0, 2.5), (0, 2.0, 2.0)], "target int, y double, yhat double")
    assert regression_metrics(exact).first().r2_score == 1.0
    assert regression_metrics(off).first().r2_score == 0.0


def test_registry_resolution(spark):
    schema = "name string, version int, run_id string, stage string, creation_timestamp bigint"
    v = spark.createDataFrame([("pollution_predictor", 1, "r1", "Production", 0),
                               ("pollution_predictor", 2, "r2", "Production", 0),
                               ("pollution_predictor", 3, "r3", "None", 0)], schema)
    assert resolve_model_row(v).version == 2
    assert resolve_model_row(v, version=3).run_id == "r3"
    none_only = v.where("stage = 'None'")
    assert resolve_model_row(none_only).version == 3
    with pytest.raises(ValueError):
        resolve_model_row(v.where("false"))
    assert resolve_model(v, run_id="r1").first().version == 1


def test_dst_strict(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 3, 30),), (dt.datetime(2024, 10, 27, 3, 30),),
                                (dt.datetime(2024, 1, 1, 3, 30),)], "ts timestamp_ntz")
    lenient = localize(df, "ts").collect()
    assert len(lenient) == 3
    for bad in df.collect()[:2]:
        one = spark.createDataFrame([(bad.ts,)], "ts timestamp_ntz")
        with pytest.raises(Exception):
            localize(one, "ts", strict=True).collect()
    ok = spark.createDataFrame([(dt.datetime(2024, 1, 1, 3, 30),)], "ts timestamp_ntz")
    assert localize(ok, "ts", strict=True).first().ts is not None


DOC = ('<wfs:FeatureCollection ' + MP.NS + '><wfs:member>'
       '<gml:Point gml:id="point-1-100"><gml:name>A</gml:name><gml:pos>60.10 24.90</gml:pos></gml:Point>'
       '<gmlcov:positions>60.10 24.90 0 60.10 24.90 3600</gmlcov:positions>'
       '<gml:doubleOrNilReasonTupleList>1.5 NaN 2.5 3.5</gml:doubleOrNilReasonTupleList>'
       '<swe:field name="no2"><swe:label>Nitrogen dioxide</swe:label><swe:uom code="ug/m3"/></swe:field>'
       '<swe:field name="pm10"><swe:label>Particulate matter &lt; 10 µm</swe:label><swe:uom code="ug/m3"/>'
       '</swe:field></wfs:member></wfs:FeatureCollection>')


def test_decode_fixture_document(spark):
    docs = spark.createDataFrame([(1, 0, DOC)], "doc_id bigint, chunk_no int, xml string")
    out = sorted((r.ts, r.indicator, r.value) for r in MP.decode_multipoint(docs).collect())
    e = dt.datetime(1970, 1, 1)
    assert out == [(e, "Nitrogen dioxide", 1.5), (e, "Particulate matter < 10 µm", None),
                   (e + H, "Nitrogen dioxide", 2.5), (e + H, "Particulate matter < 10 µm", 3.5)]
    loc = MP.decode_locations(docs).first()
    assert (loc.station, loc.fmisid, loc.latitude, loc.longitude) == ("A", 100, 60.10, 24.90)


def test_decode_overwrite_keeps_last(spark):
    doc = DOC.replace("60.10 24.90 0 60.10 24.90 3600", "60.10 24.90 0 60.10 24.90 0")
    docs = spark.createDataFrame([(1, 0, doc)], "doc_id bigint, chunk_no int, xml string")
    out = {r.indicator: r.value for r in MP.decode_multipoint(docs).collect()}
    assert out == {"Nitrogen dioxide": 2.5, "Particulate matter < 10 µm": 3.5}


def test_unknown_coordinate_strict(spark):
    doc = DOC.replace("60.10 24.90 0 60.10 24.90 3600", "60.10 24.90 0 61.00 24.90 3600")
    docs = spark.createDataFrame([(1, 0, doc)], "doc_id bigint, chunk_no int, xml string")
    assert MP.decode_multipoint(docs, strict=False).count() == 2     # lenient: the unknown row is dropped
    with pytest.raises(Exception):
        MP.decode_multipoint(docs).collect()


def test_read_table_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "x.txt"))
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "missing.parquet"))


def test_query_routing(spark):
    df = spark.createDataFrame([("urban::observations::airquality::hourly::multipointcoverage",)], "q string")
    assert df.select(S.require_multipoint("q")).first()[0] == "multipoint"
    bad = spark.createDataFrame([("fmi::forecast::grid",)], "q string")
    with pytest.raises(Exception):
        bad.select(S.require_multipoint("q")).collect()


def test_ts_lit_keeps_wall_clock_in_any_zone(spark):
    """A naive datetime becomes the same timestamp_ntz whatever the session
    or process zone (``F.lit`` would read it in the process zone)."""
    from aerogrid.session import configure
    v = dt.datetime(2024, 3, 31, 3, 30)
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = spark.range(1).select(S.ts_lit(v).alias("t"), S.ts_lit("2024-03-31 03:30:00").alias("u")).first()
        assert got.t == v and got.u == v
    finally:
        configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_densify_complete_axis(spark):
    """Q2 switch: a time step missing from every series becomes a NULL row,
    then filled; the default grid keeps only timestamps some series has."""
    rows = [("A", "x", T0, 1.0), ("B", "x", T0 + 3 * H, 4.0)]
    obs = spark.createDataFrame(rows, "station string, indicator string, ts timestamp_ntz, value double")
    series = [("A", "x"), ("B", "x")]
    assert densify(obs, series).count() == 4
    g = densify(obs, series, step_hours=1)
    assert g.count() == 8
    a = [r.value for r in fill_gaps(g).where("station = 'A'").orderBy("ts").collect()]
    assert a == [1.0, 1.0, 1.0, 1.0]
    # a long span: the axis is expanded in chunks over many rows
    far = spark.createDataFrame([("A", "x", T0, 1.0), ("A", "x", T0 + 5000 * H, 2.0)],
                                "station string, indicator string, ts timestamp_ntz, value double")
    d = densify(far, [("A", "x")], step_hours=1)
    assert d.count() == 5001 and d.select("ts").distinct().count() == 5001
    assert d.where("value IS NOT NULL").count() == 2


def test_broadcast_checked_bounds_rows_and_bytes(spark):
    from aerogrid.operators.joins import broadcast_checked
    small = spark.range(10).selectExpr("id", "repeat('x', 10) AS s")
    assert "broadcast" in small.join(broadcast_checked(small), "id")._jdf.queryExecution().analyzed().toString().lower()
    # too many rows, then too many bytes: no hint
    assert broadcast_checked(small, max_rows=5) is small
    assert broadcast_checked(small, max_bytes=50) is small


def test_stream_leaves_session_settings_alone(spark):
    from aerogrid.plans.catalog_io import q_t3
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key, None)
    assert q_t3(spark, "/root/testdata/sf0.001").count() > 0
    assert spark.conf.get(key, None) == before
