"""Registered document queries (S5-S10, J3, F11, F12): documents are landed
from the deduplicated observations by Spark and decoded back."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.catalog import register
from aerogrid.functions import scalars as S
from aerogrid.operators.joins import resolve_station
from aerogrid.plans.catalog_core import deduped
from aerogrid.plans.sqlparts import DEDUP_SQL, STATIONS_SQL
from aerogrid.session import cut_lineage
from aerogrid.sources import multipoint as MP
from aerogrid.sources.testbed import testbed_stations

IND_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({j}, '{code}', '{ind}')" for j, (code, ind) in enumerate(zip(MP.FIELD_CODES, K.INDICATORS))
) + ") AS t(field_no, code, indicator)"

CELLS_SQL = f"""
SELECT c.station, c.ts, i.field_no, i.indicator, d.value
FROM (SELECT DISTINCT station, ts FROM ({DEDUP_SQL}) x) c
CROSS JOIN ({IND_SQL}) i
LEFT JOIN ({DEDUP_SQL}) d ON d.station = c.station AND d.ts = c.ts AND d.indicator = i.indicator
"""

DECODED_SQL = f"SELECT station, indicator, ts, value, '{MP.UNITS}' AS units FROM ({CELLS_SQL}) c"


def docs(spark, sf_dir):
    """Documents landed once (reliable checkpoint), as raw documents would be."""
    return cut_lineage(MP.build_documents(deduped(spark, sf_dir), testbed_stations(spark)))


@register("s5_decode_multipoint", DECODED_SQL)
def q_s5(spark, sf_dir):
    return MP.decode_multipoint(docs(spark, sf_dir)).select("station", "indicator", "ts", "value", "units")


@register("s10_decode_members", DECODED_SQL)
def q_s10(spark, sf_dir):
    d = cut_lineage(MP.build_member_documents(deduped(spark, sf_dir), testbed_stations(spark)))
    return MP.decode_members(d).select("station", "indicator", "ts", "value", "units")


@register("s8_document_time", DECODED_SQL)
def q_s8(spark, sf_dir):
    """Documents of one station and hour each, whose time stands once for the whole document."""
    d = cut_lineage(MP.build_timed_documents(deduped(spark, sf_dir), testbed_stations(spark)))
    return MP.decode_multipoint(d).select("station", "indicator", "ts", "value", "units")


@register("f26_routed_decode", DECODED_SQL)
def q_f26(spark, sf_dir):
    """Odd days come as member collections, even ones as plain coverages; the query id tells which."""
    obs = deduped(spark, sf_dir)
    odd = F.dayofyear("ts") % 2 == 1
    query = lambda df, name: df.withColumn("query_id", F.lit(f"{name}::multipointcoverage"))
    stations = testbed_stations(spark)
    members = query(MP.build_member_documents(obs.where(odd), stations), "stuk::observations::air::radionuclide-activity-concentration")
    plain = query(MP.build_documents(obs.where(~odd), stations), "urban::observations::airquality::hourly")
    d = cut_lineage(plain.unionByName(members.select(plain.columns)))
    return MP.decode_routed(d).select("station", "indicator", "ts", "value", "units")


@register("s6_decode_locations", f"""
SELECT station, fmisid, latitude, longitude FROM ({STATIONS_SQL}) s
WHERE station IN (SELECT DISTINCT station FROM ({DEDUP_SQL}) d)""")
def q_s6(spark, sf_dir):
    return MP.decode_locations(docs(spark, sf_dir)).drop("doc_id").distinct()


@register("s7_decode_fields", f"""
SELECT DISTINCT field_no, code, indicator, '{MP.UNITS}' AS units FROM ({IND_SQL}) i
WHERE EXISTS (SELECT 1 FROM ({DEDUP_SQL}) d)""")
def q_s7(spark, sf_dir):
    return MP.decode_fields(docs(spark, sf_dir)).drop("doc_id").distinct()


@register("s9_collect_series", f"""
SELECT station, indicator, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
       CAST(row_number() OVER (PARTITION BY station, indicator, date_trunc('day', ts) ORDER BY ts) - 1 AS INTEGER)
           AS pos, ts, value
FROM ({CELLS_SQL}) c""")
def q_s9(spark, sf_dir):
    series = MP.collect_series(MP.decode_multipoint(docs(spark, sf_dir)))
    z = series.select("doc_id", "station", "indicator",
                      F.posexplode(F.arrays_zip("times", "values")).alias("pos", "p"))
    return z.select("station", "indicator", F.date_trunc("day", "p.times").cast("timestamp_ntz").alias("day"),
                    "pos", F.col("p.times").alias("ts"), F.col("p.values").alias("value"))


@register("j3_resolve_station", f"SELECT DISTINCT station, ts FROM ({DEDUP_SQL}) d")
def q_j3(spark, sf_dir):
    d = docs(spark, sf_dir)
    pos = S.text_to_doubles(F.xpath_string("xml", F.lit("//*[local-name()='positions']")))
    # parse once into a column; lambdas below index it, never re-parse it
    parsed = d.select(pos.alias("pos"))
    pts = parsed.select(F.posexplode_outer(S.stride("pos", 3, 0)).alias("i", "lat"), "pos").where("i IS NOT NULL")
    pts = pts.select(F.col("lat"), F.get("pos", F.col("i") * 3 + 1).alias("lon"),
                     S.epoch_seconds_to_ts(F.get("pos", F.col("i") * 3 + 2)).alias("ts"))
    return resolve_station(pts, testbed_stations(spark)).select("station", "ts")


_ROWS_SQL = f"""
SELECT CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS doc_id, c.*,
       row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, station) - 1 AS r
FROM (SELECT DISTINCT station, ts FROM ({DEDUP_SQL}) x) c"""


@register("f11_f13_parse_values", f"""
SELECT r.doc_id, CAST(r.r * {len(K.INDICATORS)} + c.field_no AS INTEGER) AS pos, c.value
FROM ({_ROWS_SQL}) r JOIN ({CELLS_SQL}) c ON r.station = c.station AND r.ts = c.ts""")
def q_f11(spark, sf_dir):
    d = docs(spark, sf_dir)
    vals = S.text_to_doubles(F.xpath_string("xml", F.lit("//*[local-name()='doubleOrNilReasonTupleList']")))
    return d.select("doc_id", F.posexplode_outer(vals).alias("pos", "value")).where("pos IS NOT NULL")


@register("f12_stride_positions", f"""
SELECT r.doc_id, CAST(r.r AS INTEGER) AS i, s.latitude AS lat, s.longitude AS lon, r.ts
FROM ({_ROWS_SQL}) r JOIN ({STATIONS_SQL}) s ON r.station = s.station""")
def q_f12(spark, sf_dir):
    d = docs(spark, sf_dir)
    pos = S.text_to_doubles(F.xpath_string("xml", F.lit("//*[local-name()='positions']")))
    parsed = d.select("doc_id", pos.alias("pos"))
    z = parsed.select("doc_id", F.arrays_zip(S.stride("pos", 3, 0).alias("lat"), S.stride("pos", 3, 1).alias("lon"),
                                             S.stride("pos", 3, 2).alias("ep")).alias("z"))
    e = z.select("doc_id", F.posexplode_outer("z").alias("i", "p")).where("i IS NOT NULL")
    return e.select("doc_id", "i", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"),
                    S.epoch_seconds_to_ts(F.col("p.ep")).alias("ts"))
