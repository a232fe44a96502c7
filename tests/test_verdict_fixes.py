"""Windows longer than a block, many series, odd documents, repeated saves."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from aerogrid.operators.aggregates import dedup_first, dedup_last
from aerogrid.operators.joins import densify, merge_on, resolve_station, series_table
from aerogrid.operators.windows import window_arrays
from aerogrid.plans import registry as R
from aerogrid.plans.model import Model
from aerogrid.sources import multipoint as MP
from aerogrid.sources.tables import freshness
from aerogrid.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


def test_windows_longer_than_a_block(spark):
    df = spark.createDataFrame([("A", i, float(i)) for i in range(400)], "station string, idx long, v double")
    rows = window_arrays(df, ["station"], "idx", ["v"], before=300, after=2).collect()
    assert len(rows) == 400 - 300 - 2 + 1
    assert all([x.v for x in r.lag] == [float(r.idx - 300 + k) for k in range(300)] for r in rows)


def test_densify_plans_many_series_at_once(spark):
    n = 4000
    obs = spark.createDataFrame([(f"s{i}", "x", T0 + dt.timedelta(hours=i % 2), 1.0) for i in range(n)],
                                "station string, indicator string, ts timestamp_ntz, value double")
    series = series_table(obs)
    began = time.time()
    grid = densify(obs, series)
    assert time.time() - began < 3
    assert grid.count() == 2 * n and grid.where("value is not null").count() == n


def doc(fields: str, values: str, positions: str = "60 24 0", points: str = "", time_position: str = "") -> str:
    points = points or "<gml:Point gml:id='p-1'><gml:name>A</gml:name><gml:pos>60 24</gml:pos></gml:Point>"
    return (f"<wfs:FeatureCollection {MP.NS} xmlns:xlink='x'>{points}<gml:timePosition>{time_position}</gml:timePosition>"
            f"<gmlcov:positions>{positions}</gmlcov:positions><gml:doubleOrNilReasonTupleList>{values}</gml:doubleOrNilReasonTupleList>"
            f"<swe:DataRecord>{fields}</swe:DataRecord></wfs:FeatureCollection>")


INLINE = '<swe:field name="no2"><swe:Quantity><swe:label>NO2 &lt; x</swe:label><swe:uom code="ug"/></swe:Quantity></swe:field>'
LINKED = '<swe:field name="pm10" xlink:href="PM10"/>'


def test_linked_and_inline_fields_keep_their_places(spark):
    docs = spark.createDataFrame([(1, 0, doc(INLINE + LINKED, "1 2")), (2, 0, doc(LINKED + INLINE, "3 4"))], "doc_id long, chunk_no int, xml string")
    params = spark.createDataFrame([("PM10", "Particles", None)], "href string, name string, units string")
    fields = sorted(tuple(r) for r in MP.decode_fields(docs, params).collect())
    assert fields == [(1, 0, "no2", "NO2 < x", "ug"), (1, 1, "pm10", "Particles", ""), (2, 0, "pm10", "Particles", ""), (2, 1, "no2", "NO2 < x", "ug")]
    values = sorted((r.doc_id, r.indicator, r.value) for r in MP.decode_multipoint(docs, params=params).collect())
    assert values == [(1, "NO2 < x", 1.0), (1, "Particles", 2.0), (2, "NO2 < x", 4.0), (2, "Particles", 3.0)]
    assert {r.indicator for r in MP.decode_multipoint(docs).collect()} == {"NO2 < x", "pm10"}


def test_empty_documents_and_repeated_points(spark):
    twice = ("<gml:Point gml:id='p-1'><gml:name>Old</gml:name><gml:pos>60 24</gml:pos></gml:Point>"
             "<gml:Point gml:id='p-2'><gml:name>New</gml:name><gml:pos>60 24</gml:pos></gml:Point>")
    docs = spark.createDataFrame([(1, 0, doc(INLINE, "", positions="")), (2, 0, doc(INLINE, "7", points=twice))],
                                 "doc_id long, chunk_no int, xml string")
    assert [(r.doc_id, r.station, r.value) for r in MP.decode_multipoint(docs).collect()] == [(2, "New", 7.0)]


def test_second_save_of_a_run_replaces_it(spark, tmp_path):
    root = str(tmp_path)
    model = Model("run-1", [("A", "x")], 2, 1, [0.0, 1.0], [1.0, 2.0], np.array([[0.5, -0.5]]), np.array([3.0]), 1.0, {"mae": 0.1})
    R.save_model(spark, model, root, 1)
    R.save_model(spark, model, root, 2)
    R.save_model(spark, Model("run-2", [("A", "x")], 2, 1, [9.0, 9.0], [1.0, 1.0], np.array([[8.0, 8.0]]), np.array([7.0]), 1.0, {"mae": 0.2}), root, 3)
    for kw, w in (({"version": 2}, [[0.5, -0.5]]), ({"run_id": "run-2"}, [[8.0, 8.0]]), ({}, [[8.0, 8.0]])):
        back = R.load_registered(spark, root, **kw)
        assert back.W.tolist() == w and len(back.mean) == 2
    assert R.read(spark, root, "model_versions").count() == 3
    with pytest.raises(ValueError):
        R.load_registered(spark, root, version=9)


def test_freshness_lists_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).repartition(3).write.parquet(path)
    row = freshness(spark, path, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).first()
    assert row["exists"] and row["n_files"] == 3 and row["age_hours"] < 1
    assert not freshness(spark, path + "-none", T0).first()["exists"]


def test_late_file_counts_in_hourly_means(spark, tmp_path):
    """Two runs over one landing folder; the second file is older than any watermark would allow."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

    def land(no, rows):
        (tmp_path / "in" / no).mkdir(parents=True)
        frame = pd.DataFrame([(i, pd.Timestamp(t), 0, "a", v, None) for i, t, v in rows],
                             columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        table = pa.Table.from_pandas(frame.astype({"ts": "datetime64[us]"}), preserve_index=False)
        pq.write_table(table.set_column(5, "props", pa.nulls(len(frame), pa.string())), tmp_path / "in" / no / "events.parquet")

    out = str(tmp_path / "out")
    for no, rows in (("1", [(1, "2024-03-09 10:05", 4.0), (2, "2024-03-01 10:05", 1.0), (3, "2024-03-01 10:10", float("nan"))]),
                     ("2", [(4, "2024-03-01 10:59", 3.0), (5, "2024-01-01 00:00", 7.0)])):
        land(no, rows)
        ingest.hourly_means_stream(spark, str(tmp_path / "in" / "*"), schema, out)
    found = {str(r["window_start"]): (r["mean_value"], r["n"]) for r in ingest.read_hourly_means(spark, out).collect()}
    assert found == {"2024-03-09 10:00:00": (4.0, 1), "2024-03-01 10:00:00": (2.0, 3), "2024-01-01 00:00:00": (7.0, 1)}


def test_late_file_is_kept_once_by_the_stream_dedup(spark, tmp_path):
    """Three runs over one landing folder: a back-filled file far older than the
    first, repeated keys inside and across files, null keys."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    out, seen = str(tmp_path / "out"), {}
    landings = [[(1, "2024-03-09 10:05", "a", 4.0), (2, "2024-03-09 10:50", "a", 4.5), (3, None, "a", 1.0)],
                [(4, "2024-01-01 00:00", "a", 7.0), (5, "2024-01-01 00:30", "a", 7.5), (6, "2024-03-09 10:59", "a", 5.0),
                 (7, "2024-01-01 00:00", None, 8.0), (8, None, "a", 2.0)],
                [(9, "2024-01-01 00:10", "a", 9.0), (10, "2024-01-01 00:10", None, 9.0), (11, "2023-01-01 05:00", "b", 3.0)]]
    for no, rows in enumerate(landings):
        table = pa.table({"event_id": [r[0] for r in rows], "ts": pa.array([r[1] and dt.datetime.fromisoformat(r[1]) for r in rows], pa.timestamp("us")),
                          "user_id": pa.array([0] * len(rows), pa.int64()), "event_type": pa.array([r[2] for r in rows], pa.string()),
                          "value": [r[3] for r in rows], "props": pa.nulls(len(rows), pa.string())})
        (tmp_path / "in" / str(no)).mkdir(parents=True)
        pq.write_table(table, tmp_path / "in" / str(no) / "events.parquet")
        ingest.dedup_stream(spark, str(tmp_path / "in" / "*"), schema, out)
        for i, ts, station, _ in rows:
            seen.setdefault((station, ts and ts[:13]), set()).add(i)
        found = spark.read.parquet(out).collect()
        keys = [(r["station"], r["ts"] and str(r["ts"])[:13]) for r in found]
        assert len(keys) == len(set(keys)) and set(keys) == set(seen)
        assert all(r["seq"] in seen[k] for k, r in zip(keys, found, strict=True))
    values = {r["seq"]: r["value"] for r in found}
    assert all(values[i] == v for rows in landings for i, _, _, v in rows if i in values)


def test_dedup_takes_one_whole_row_whatever_the_order_columns(spark):
    rows = [("k", 1, 5, 1.0, 10), ("k", 0, 9, 2.0, 20), ("k", 0, 7, None, 30), ("n", None, 3, 4.0, 40), ("n", 0, None, 5.0, 50)]
    df = spark.createDataFrame(rows, "key string, chunk_no int, seq long, value double, mark int")
    first = {r.key: (r.chunk_no, r.seq, r.value, r.mark) for r in dedup_first(df, ["key"]).collect()}
    last = {r.key: (r.chunk_no, r.seq, r.value, r.mark) for r in dedup_last(df, ["key"], ["chunk_no", "seq"]).collect()}
    assert first == {"k": (0, 7, None, 30), "n": (None, 3, 4.0, 40)}       # nulls stand first
    assert last == {"k": (1, 5, 1.0, 10), "n": (0, None, 5.0, 50)}
    named = df.withColumn("name", F.concat(F.lit("m"), "mark"))            # with a text: the sorted path, the same rows
    assert {r.key: r.name for r in dedup_first(named, ["key"]).collect()} == {"k": "m30", "n": "m40"}


def test_outer_merge_joins_null_keys_and_keeps_one_key_column(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "ts int, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (4, "r")], "ts int, y string")
    out = merge_on(a, b)
    assert out.columns == ["ts", "x", "y"]
    assert set(map(tuple, out.collect())) == {(1, "a", "p"), (None, "b", "q"), (3, "c", None), (4, None, "r")}
    again = merge_on(a, a.withColumnRenamed("x", "z"))                     # a table with itself
    assert set(map(tuple, again.collect())) == {(1, "a", "a"), (None, "b", "b"), (3, "c", "c")}


def test_unknown_coordinates_raise_unless_asked_not_to(spark):
    stations = spark.createDataFrame([("A", 60.0, 24.0)], "station string, latitude double, longitude double")
    points = spark.createDataFrame([(60.0, 24.0), (61.0, 24.0)], "lat double, lon double")
    with pytest.raises(Exception, match="unknown coordinate"):
        resolve_station(points, stations).collect()
    assert [r.station for r in resolve_station(points, stations, strict=False).collect()] == ["A"]


def test_document_time_belongs_to_the_only_point(spark):
    two = ("<gml:Point gml:id='p-1'><gml:name>A</gml:name><gml:pos>60 24</gml:pos></gml:Point>"
           "<gml:Point gml:id='p-2'><gml:name>B</gml:name><gml:pos>61 24</gml:pos></gml:Point>")
    kinds = "doc_id long, chunk_no int, xml string"
    one = spark.createDataFrame([(1, 0, doc(INLINE, "7", positions="", time_position="2024-01-01T05:00:00Z"))], kinds)
    assert [(r.station, r.ts, r.value) for r in MP.decode_multipoint(one).collect()] == [("A", T0 + dt.timedelta(hours=5), 7.0)]
    both = spark.createDataFrame([(1, 0, doc(INLINE, "7", positions="", points=two, time_position="2024-01-01T05:00:00Z"))], kinds)
    with pytest.raises(Exception, match="unknown location"):
        MP.decode_multipoint(both).collect()
    assert MP.decode_multipoint(both, strict=False).count() == 0


def test_documents_of_an_unknown_kind_raise(spark):
    known = (1, 0, doc(INLINE, "7"), "urban::MultipointCoverage")
    kinds = "doc_id long, chunk_no int, xml string, query_id string"
    assert [r.value for r in MP.decode_routed(spark.createDataFrame([known], kinds)).collect()] == [7.0]
    for query_id in ("forecast::grid", None):
        with pytest.raises(Exception):
            MP.decode_routed(spark.createDataFrame([known, (2, 0, doc(INLINE, "8"), query_id)], kinds)).collect()
