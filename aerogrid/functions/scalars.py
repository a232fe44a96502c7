"""Column-level scalar helpers.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` only, so
the expressions stay inside whole-stage codegen; no Python per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerogrid import constants as K

TWO_PI = 2.0 * math.pi


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ts_lit(v) -> Column:
    """A ``timestamp_ntz`` literal from a datetime, date or ISO text.

    Goes through text, so no time zone is involved: a naive ``datetime``
    handed to ``F.lit`` is read in the Python process's local zone.
    Columns pass through unchanged.
    """
    if isinstance(v, Column):
        return v
    if v is None:
        return F.lit(None).cast("timestamp_ntz")
    text = v.isoformat(sep=" ") if hasattr(v, "hour") else (v.isoformat() if hasattr(v, "isoformat") else str(v))
    return F.lit(text).cast("timestamp_ntz")


# -- F2 / F1: calendar parts and cyclic encoding ------------------------------

def hour_of(ts) -> Column:
    """Hour of day 0-23."""
    return F.hour(_c(ts))


def weekday_of(ts) -> Column:
    """Weekday with Monday = 0 (``F.weekday``, not ``dayofweek``)."""
    return F.weekday(_c(ts))


def cyclic_time_features(ts) -> list[Column]:
    """hour_sin, hour_cos, day_sin, day_cos of a timestamp column."""
    h = hour_of(ts).cast("double")
    d = weekday_of(ts).cast("double")
    return [
        F.sin(F.lit(TWO_PI) * h / 24.0).alias("hour_sin"),
        F.cos(F.lit(TWO_PI) * h / 24.0).alias("hour_cos"),
        F.sin(F.lit(TWO_PI) * d / 7.0).alias("day_sin"),
        F.cos(F.lit(TWO_PI) * d / 7.0).alias("day_cos"),
    ]


def with_time_features(df, ts: str = "ts"):
    """The feature table (D8): every column of ``df`` plus the four cyclic
    time features; one output row per input row."""
    return df.select("*", *cyclic_time_features(ts))


# -- F3 / F4 / F5: series keys -------------------------------------------------

def key_pollutant(key) -> Column:
    """Part before the first ``_``; the whole key when there is none."""
    k = _c(key)
    return F.when(k.contains("_"), F.split(k, "_", 2).getItem(0)).otherwise(k)


def key_station(key) -> Column:
    """Part after the first ``_``; ``Unknown Station`` when there is none."""
    k = _c(key)
    return F.when(k.contains("_"), F.split(k, "_", 2).getItem(1)).otherwise(F.lit(K.UNKNOWN_STATION))


def normalise_pollutant(name) -> Column:
    """``Particulate matter < 10 µm`` -> ``PM10``; other names unchanged."""
    n = _c(name)
    return F.replace(F.replace(n, F.lit(K.PM_LONG_PREFIX), F.lit(K.PM_SHORT_PREFIX)),
                     F.lit(K.MICRON_SUFFIX), F.lit(""))


def series_key(indicator, station) -> Column:
    """``<indicator>_<station>``."""
    return F.concat_ws("_", _c(indicator), _c(station))


def forecast_key(feature) -> Column:
    """Forecast document key: normalised pollutant + ``_`` + station (or the
    normalised feature when it has no ``_``)."""
    f = _c(feature)
    return F.when(f.contains("_"),
                  F.concat_ws("_", normalise_pollutant(F.split(f, "_", 2).getItem(0)),
                              F.split(f, "_", 2).getItem(1))
                  ).otherwise(normalise_pollutant(f))


# -- F6 / F7 / F8 / F9 / F10: labels and time arithmetic -------------------------

def hour_label(j) -> Column:
    """``hour_<j>``."""
    return F.concat(F.lit("hour_"), _c(j).cast("string"))


def add_hours(ts, hours) -> Column:
    return _c(ts) + F.make_dt_interval(F.lit(0), _c(hours).cast("int"))


def iso_z(ts) -> Column:
    """ISO-8601 to the second with a literal ``Z``."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_local(ts) -> Column:
    """ISO-8601 without zone (naive datetime ``isoformat``)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def epoch_seconds_to_ts(sec) -> Column:
    """Epoch seconds (double) -> ``timestamp_ntz`` (session zone is UTC)."""
    return F.timestamp_micros((_c(sec) * 1_000_000).cast("long")).cast("timestamp_ntz")


def epoch_millis_text(ms) -> Column:
    """Epoch milliseconds -> ``yyyy-MM-dd HH:mm``."""
    return F.date_format(F.timestamp_millis(_c(ms).cast("long")), "yyyy-MM-dd HH:mm")


def age_hours(later, earlier) -> Column:
    """Timestamp difference in hours."""
    return (F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))) / 3.6e9


# -- F11 / F12 / F13 / F14 / F15: array reshaping -------------------------------

def text_to_doubles(text) -> Column:
    """Whitespace-separated numbers -> array<double>; ``NaN`` and junk -> NULL."""
    t = F.trim(_c(text))
    parts = F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))
    # NaN is "missing": map it to NULL (Spark's ignorenulls would not skip NaN).
    return F.transform(parts, lambda s: F.nanvl(s.try_cast("double"), F.lit(None).cast("double")))


def stride(arr, step: int, offset: int) -> Column:
    """``arr[offset::step]`` for a flat array."""
    a = _c(arr)
    n = F.floor((F.size(a) - offset + step - 1) / step).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.get(a, i * step + offset))


def cell(arr, row, col, width) -> Column:
    """Row-major lookup ``arr[row * width + col]``."""
    return F.get(_c(arr), _c(row) * _c(width) + _c(col))


def check_reshape(arr, rows, cols) -> Column:
    """Raise when a flat array cannot be reshaped to (rows, cols)."""
    a = _c(arr)
    return F.when(F.size(a) == _c(rows) * _c(cols), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("cannot reshape array of size "), F.size(a).cast("string"),
                               F.lit(" into shape ("), _c(rows).cast("string"), F.lit(","),
                               _c(cols).cast("string"), F.lit(")"))))


def target_step(t, n_features) -> Column:
    """Flat target index -> horizon step (0-based)."""
    return F.floor(_c(t) / _c(n_features)).cast("int")


def target_feature(t, n_features) -> Column:
    """Flat target index -> feature index."""
    return F.pmod(_c(t), _c(n_features)).cast("int")


# -- F19 / F20 / F22 / F23 / F25 / F26: labels and formats -----------------------

def pm10_colour(v) -> Column:
    """Colour band of a PM10 value; NULL and NaN count as not above any band."""
    x = _c(v)
    expr = None
    for bound, colour in K.PM10_COLOUR_BANDS:
        cond = x.isNotNull() & ~F.isnan(x) & (x > bound)
        expr = F.when(cond, colour) if expr is None else expr.when(cond, colour)
    return expr.otherwise(K.PM10_COLOUR_DEFAULT)


def r2_band(v) -> Column:
    x = _c(v)
    expr = None
    for bound, label in K.R2_BANDS:
        cond = x.isNotNull() & ~F.isnan(x) & (x > bound)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(K.R2_BAND_DEFAULT)


def id_suffix(gml_id) -> Column:
    """Last ``-`` separated part as int (``point-1-100`` -> 100)."""
    return F.element_at(F.split(_c(gml_id), "-"), -1).try_cast("int")


def short_run_id(run_id) -> Column:
    r = _c(run_id)
    return F.when(F.length(r) > 8, F.concat(F.substring(r, 1, 8), F.lit("..."))).otherwise(r)


def signed(v, decimals: int = 1) -> Column:
    """``+1.2`` / ``-0.3`` text, only for presentation at the edge."""
    return F.format_string(f"%+.{decimals}f", _c(v))


def fixed(v, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f", _c(v))


def with_default(v, default: float) -> Column:
    return F.coalesce(_c(v), F.lit(float(default)))


def require_multipoint(query_id) -> Column:
    """Route by query kind; anything but a multipoint coverage raises."""
    q = F.lower(_c(query_id))
    return F.when(q.contains("multipointcoverage"), F.lit("multipoint")).otherwise(
        F.raise_error(F.concat(F.lit("No parser available for "), _c(query_id))))


def is_member_collection(query_id) -> Column:
    """Documents of radionuclide queries hold many members to decode one by one."""
    return F.lower(_c(query_id)).contains("radionuclide-activity-concentration")
