"""Multipoint coverage documents: decode to observations.

Input ``raw_docs(doc_id bigint, chunk_no int, xml string)``: one landed XML
document per row.  Decoding is row-local SQL (``xpath`` with ``local-name()``,
``split``, index arithmetic, ``posexplode``), so it scales with the number of
documents and needs no shuffle; no Python runs per row.

Document shape: ``Point`` elements (id ``...-<fmisid>``, name, ``lat lon``),
``positions`` = flat ``lat lon epoch`` triplets (one per row), the value list
= rows x fields flattened row-major, and ``field`` elements (name, label,
unit).  Station of a row = the point with the same coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid import constants as K
from aerogrid.functions import scalars as S
from aerogrid.operators.aggregates import dedup_last

NS = ('xmlns:wfs="http://www.opengis.net/wfs/2.0" xmlns:gml="http://www.opengis.net/gml/3.2" '
      'xmlns:gmlcov="http://www.opengis.net/gmlcov/1.0" xmlns:swe="http://www.opengis.net/swe/2.0"')
FIELD_CODES = ["no2", "pm10", "pm25"]   # field names written for INDICATORS, in order
UNITS = "ug/m3"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _x(path: str) -> Column:
    return F.lit(path)


def _any(tag: str) -> str:
    return f"*[local-name()='{tag}']"


def _esc(c: Column) -> Column:
    """XML text escaping for names."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


# ------------------------------------------------------------ documents -----

def _fields_xml() -> str:
    parts = []
    for code, label in zip(FIELD_CODES, K.INDICATORS):
        lab = label.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        parts.append(f'<swe:field name="{code}"><swe:label>{lab}</swe:label><swe:uom code="{UNITS}"/></swe:field>')
    return "".join(parts)


def _member_xml(rows: Column) -> Column:
    """One ``wfs:member`` from an array of row structs (ts, station, fmisid, lat, lon, vals)."""
    pts = F.array_distinct(F.transform(rows, lambda r: F.struct(r["station"].alias("station"),
                                                                r["fmisid"].alias("fmisid"),
                                                                r["lat"].alias("lat"), r["lon"].alias("lon"))))
    point_xml = F.array_join(F.transform(pts, lambda p: F.concat(
        F.lit('<gml:Point gml:id="point-1-'), p["fmisid"].cast("string"), F.lit('"><gml:name>'),
        _esc(p["station"]), F.lit("</gml:name><gml:pos>"), p["lat"].cast("string"), F.lit(" "),
        p["lon"].cast("string"), F.lit("</gml:pos></gml:Point>"))), "")
    positions = F.array_join(F.transform(rows, lambda r: F.concat_ws(
        " ", r["lat"].cast("string"), r["lon"].cast("string"),
        F.unix_seconds(r["ts"].cast("timestamp")).cast("string"))), " ")
    values = F.array_join(F.flatten(F.transform(rows, lambda r: F.transform(
        r["vals"], lambda v: F.coalesce(v.cast("string"), F.lit("NaN"))))), " ")
    return F.concat(F.lit("<wfs:member>"), point_xml, F.lit("<gmlcov:positions>"), positions,
                    F.lit("</gmlcov:positions><gml:doubleOrNilReasonTupleList>"), values,
                    F.lit("</gml:doubleOrNilReasonTupleList>"), F.lit(_fields_xml()), F.lit("</wfs:member>"))


def _cells(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """One row per (day, station, ts) with the field values in field order."""
    o = obs.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    per = o.groupBy("day", "station", "ts").agg(
        F.map_from_entries(F.collect_list(F.struct("indicator", "value"))).alias("m"))
    per = per.select("day", "station", "ts", F.array(*[F.col("m")[ind] for ind in K.INDICATORS]).alias("vals"))
    dim = stations.select("station", "fmisid", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    from aerogrid.operators.joins import broadcast_checked
    return per.join(broadcast_checked(dim), "station")


def _row_struct() -> Column:
    return F.struct("ts", "station", "fmisid", "lat", "lon", "vals")


def build_documents(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Landed documents from deduplicated observations: one per day, all
    stations as points of one member (rows ordered by time, then station).

    A document holds at most #stations x rows-per-day rows: bounded by the
    station dimension and the grain, not by the history.
    """
    docs = _cells(obs, stations).groupBy("day").agg(F.array_sort(F.collect_list(_row_struct())).alias("rows"))
    xml = F.concat(F.lit(f"<wfs:FeatureCollection {NS}>"), _member_xml(F.col("rows")), F.lit("</wfs:FeatureCollection>"))
    return docs.select((F.unix_seconds(F.col("day").cast("timestamp")) / 86400).cast("bigint").alias("doc_id"),
                       F.lit(0).alias("chunk_no"), xml.alias("xml"))


def build_member_documents(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Collection documents: one per day with one member per station (the
    many-member layout that is decoded member by member)."""
    members = (_cells(obs, stations).groupBy("day", "station")
               .agg(F.array_sort(F.collect_list(_row_struct())).alias("rows"))
               .select("day", "station", _member_xml(F.col("rows")).alias("member")))
    docs = members.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("station", "member"))).alias("ms"))
    xml = F.concat(F.lit(f"<wfs:FeatureCollection {NS}>"),
                   F.array_join(F.col("ms.member"), ""), F.lit("</wfs:FeatureCollection>"))
    return docs.select((F.unix_seconds(F.col("day").cast("timestamp")) / 86400).cast("bigint").alias("doc_id"),
                       F.lit(0).alias("chunk_no"), xml.alias("xml"))


def build_timed_documents(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Documents of one station and time each, without positions: the time
    stands once for the whole document (S8)."""
    per = _cells(obs, stations)
    one = F.array(F.struct("ts", "station", "fmisid", "lat", "lon", "vals"))
    bare = F.regexp_replace(_member_xml(one), r"<gmlcov:positions>[^<]*", "<gmlcov:positions>")
    xml = F.concat(F.lit(f"<wfs:FeatureCollection {NS}><gml:timePosition>"), F.date_format("ts", TIME_FORMAT),
                   F.lit("</gml:timePosition>"), bare, F.lit("</wfs:FeatureCollection>"))
    return per.select(F.xxhash64("station", "ts").alias("doc_id"), F.lit(0).alias("chunk_no"), xml.alias("xml"))


# --------------------------------------------------------------- decode -----

def explode_members(raw_docs: DataFrame) -> DataFrame:
    """One row per ``wfs:member`` (S10), numbered within the document."""
    m = F.regexp_extract_all(F.col("xml"), F.lit(r"(?s)<wfs:member[ >].*?</wfs:member>"), F.lit(0))
    return raw_docs.select("doc_id", "chunk_no", F.posexplode(m).alias("member_no", "xml"))


def decode_locations(raw_docs: DataFrame) -> DataFrame:
    """Point metadata (S6): station, fmisid (id suffix, F21), latitude, longitude."""
    ids = F.xpath("xml", _x(f"//{_any('Point')}/@*[local-name()='id']"))
    names = F.xpath("xml", _x(f"//{_any('Point')}/{_any('name')}/text()"))
    pos = F.xpath("xml", _x(f"//{_any('Point')}/{_any('pos')}/text()"))
    z = raw_docs.select("doc_id", F.explode(F.arrays_zip(ids.alias("id"), names.alias("name"), pos.alias("pos")))
                        .alias("p"))
    ll = S.text_to_doubles(F.col("p.pos"))
    return z.select("doc_id", F.col("p.name").alias("station"), S.id_suffix(F.col("p.id")).alias("fmisid"),
                    F.get(ll, 0).alias("latitude"), F.get(ll, 1).alias("longitude"))


def decode_fields(raw_docs: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Field list (S7): position, name, label and unit.

    A field linked to a parameter description (``xlink:href``) takes name and
    unit from ``params(href, name, units)`` (left join; unit "" when the
    description has none); otherwise the inline label and unit code.
    """
    fields = raw_docs.select("doc_id", F.posexplode(fields_of(F.col("xml"))).alias("field_no", "f")).select(
        "doc_id", "field_no", "f.code", "f.href", "f.indicator", "f.units")
    return _with_params(fields, params).select("doc_id", "field_no", "code", "indicator", "units")


def fields_of(xml: Column) -> Column:
    """Array of ``(code, href, indicator, units)``, one per field element in
    order.  Each element is read by itself, so a part that one field lacks
    does not shift those of the next.  A linked field without an inline label
    has its code for an indicator and no unit."""
    elements = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?field\b[^>]*?(?:/>|>.*?</(?:\w+:)?field\s*>)"), F.lit(0))

    def part(e: Column, pattern: str) -> Column:
        raw = F.nullif(F.regexp_extract(e, pattern, 1), F.lit(""))
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            raw = F.replace(raw, F.lit(entity), F.lit(char))
        return raw

    def parts(e: Column) -> Column:
        code, href = part(e, r"(?s)^<[^>]*?\sname=\"([^\"]*)\""), part(e, r"(?s)^<[^>]*?\s(?:\w+:)?href=\"([^\"]*)\"")
        label, unit = part(e, r"(?s)<(?:\w+:)?label[^>]*>([^<]*)<"), part(e, r"(?s)<(?:\w+:)?uom\b[^>]*?\scode=\"([^\"]*)\"")
        linked = href.isNotNull()
        return F.struct(code.alias("code"), href.alias("href"), F.when(linked, F.coalesce(label, code)).otherwise(label).alias("indicator"),
                        F.when(linked, F.coalesce(unit, F.lit(""))).otherwise(unit).alias("units"))

    return F.transform(elements, parts)


def _with_params(rows: DataFrame, params: DataFrame | None) -> DataFrame:
    """Name and unit of linked fields from ``params(href, name, units)``."""
    if params is None:
        return rows
    known = params.select(F.col("href").alias("p_href"), F.col("name").alias("p_name"), F.col("units").alias("p_units"))
    joined = rows.join(known, rows["href"] == known["p_href"], "left")
    return joined.withColumns({
        "indicator": F.coalesce("p_name", "indicator"),
        "units": F.when(F.col("p_href").isNotNull(), F.coalesce("p_units", F.lit(""))).otherwise(F.col("units")),
    }).drop("p_href", "p_name", "p_units")


def decode_multipoint(raw_docs: DataFrame, strict: bool = True, params: DataFrame | None = None) -> DataFrame:
    """Observations from documents.

    Output ``(doc_id, chunk_no, station, indicator, units, ts, value, seq)``
    with NaN -> NULL.  The same (time, station, indicator) twice in one
    document keeps the last one (A3).  A position matching no point raises;
    with ``strict=False`` its row is dropped.  Of several points at one
    coordinate the last gives the name.  A document without positions has one
    time, and belongs to its only point (S8).  Linked fields take name and unit from
    ``params`` (see ``decode_fields``).  A document without values gives no rows.
    """
    return dedup_last(_decoded_cells(raw_docs, strict, params), ["doc_id", "station", "indicator", "ts"], ["seq"])


def _decoded_cells(raw_docs: DataFrame, strict: bool, params: DataFrame | None) -> DataFrame:
    """One row per value of the documents; other columns than ``xml`` are kept."""
    ids = [c for c in raw_docs.columns if c != "xml"]
    pos = S.text_to_doubles(F.xpath_string("xml", _x(f"//{_any('positions')}")))
    vals = S.text_to_doubles(F.xpath_string("xml", _x(f"//{_any('doubleOrNilReasonTupleList')}")))
    tpos = F.xpath_string("xml", _x(f"//{_any('timePosition')}"))
    pnames = F.xpath("xml", _x(f"//{_any('Point')}/{_any('name')}/text()"))
    ppos = F.xpath("xml", _x(f"//{_any('Point')}/{_any('pos')}/text()"))
    base = raw_docs.select(*ids, pos.alias("pos"), vals.alias("vals"), tpos.alias("tpos"), pnames.alias("pnames"),
                           ppos.alias("ppos"), fields_of(F.col("xml")).alias("fields"))
    lats, lons, epochs = S.stride("pos", 3, 0), S.stride("pos", 3, 1), S.stride("pos", 3, 2)
    # times from positions; a document without positions has one time
    times = F.when(F.size(epochs) > 0, F.transform(epochs, lambda e: S.epoch_seconds_to_ts(e))).otherwise(
        F.array_compact(F.array(F.try_to_timestamp(F.col("tpos"), F.lit(TIME_FORMAT)).cast("timestamp_ntz"))))
    # point coordinates -> name, keyed by the parsed (lat, lon) pair (J3 in-row)
    pkeys = F.transform("ppos", lambda p: F.struct(F.get(S.text_to_doubles(p), 0).alias("lat"),
                                                   F.get(S.text_to_doubles(p), 1).alias("lon")))
    step = base.select(*ids, "vals", "fields", lats.alias("lats"), lons.alias("lons"), times.alias("times"),
                       F.reverse(pkeys).alias("pkeys"), F.reverse("pnames").alias("pnames"))
    n_rows, n_f = F.size("times"), F.size("fields")
    # the shape check is a projected expression, not a filter: a filter would
    # be pushed below the parse and re-run the XPath evaluation inside it
    checked = step.withColumn("vals", F.when(S.check_reshape(F.col("vals"), n_rows, n_f), F.col("vals")))
    # *_outer: a plain explode makes the optimizer infer ``size(times) > 0``
    # and push it below this projection, re-evaluating the parse there
    rows = checked.select(*ids, "vals", "fields", "pkeys", "pnames", n_f.alias("nf"),
                          F.posexplode_outer("times").alias("i", "ts"), "lats", "lons").where(F.col("i").isNotNull())
    key = F.struct(F.get("lats", F.col("i")).alias("lat"), F.get("lons", F.col("i")).alias("lon"))
    # reversed, so the last of several points at one coordinate is found first
    station = F.when((F.size("lats") == 0) & (F.size("pnames") == 1), F.get("pnames", F.lit(0))).otherwise(
        F.get("pnames", (F.array_position("pkeys", key) - 1).cast("int")))
    if strict:
        station = F.when(station.isNotNull(), station).otherwise(
            F.raise_error(F.concat(F.lit("unknown location in document "), F.col("doc_id").cast("string"))))
    rows = rows.select(*ids, "vals", "fields", "nf", "i", "ts", station.alias("station"))
    if not strict:
        rows = rows.where(F.col("station").isNotNull())
    cells = rows.select(*ids, "station", "ts", "i", "vals", "nf",
                        F.posexplode_outer("fields").alias("j", "f")).where(F.col("j").isNotNull())
    cells = cells.select(*ids, "station", F.col("f.href").alias("href"), F.col("f.indicator").alias("indicator"),
                         F.col("f.units").alias("units"), "ts", S.cell(F.col("vals"), F.col("i"), F.col("j"), F.col("nf")).alias("value"),
                         (F.col("i") * F.col("nf") + F.col("j")).cast("long").alias("seq"))
    return _with_params(cells, params).drop("href")


def decode_members(raw_docs: DataFrame, strict: bool = True, params: DataFrame | None = None) -> DataFrame:
    """Member-by-member decode for collection documents (S10 then S5); of
    equal (station, indicator, time) the last member's last value is kept."""
    m = explode_members(raw_docs)
    wrapped = m.select("doc_id", "chunk_no", "member_no",
                       F.concat(F.lit(f"<wfs:FeatureCollection {NS}>"), F.col("xml"),
                                F.lit("</wfs:FeatureCollection>")).alias("xml"))
    cells = _decoded_cells(wrapped, strict, params)
    return dedup_last(cells, ["doc_id", "station", "indicator", "ts"], ["member_no", "seq"]).drop("member_no")


def collect_series(decoded: DataFrame) -> DataFrame:
    """Series-major view of each document (S9): per (doc, station, indicator)
    the times and values as arrays, in time order (bounded by the document)."""
    g = decoded.groupBy("doc_id", "station", "indicator", "units").agg(
        F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("pts"))
    return g.select("doc_id", "station", "indicator", "units",
                    F.col("pts.ts").alias("times"),
                    F.col("pts.value").alias("values"))


def decode_routed(raw_docs: DataFrame, query_col: str = "query_id", strict: bool = True,
                  params: DataFrame | None = None) -> DataFrame:
    """Each document by the parser its query id asks for (F26): member
    collections member by member (S10), other multipoint coverages whole (S5);
    any other id raises."""
    known = raw_docs.where(S.require_multipoint(query_col) == "multipoint")
    members = F.coalesce(S.is_member_collection(query_col), F.lit(False))
    return decode_members(known.where(members).drop(query_col), strict, params).unionByName(
        decode_multipoint(known.where(~members).drop(query_col), strict, params))
