"""Projections, filters and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from aerogrid.functions.scalars import ts_lit


def select_indicators(obs: DataFrame, names: Sequence[str], indicator: str = "indicator") -> DataFrame:
    """Keep a fixed indicator list (P1); pushed to the scan as an IN filter."""
    return obs.where(F.col(indicator).isin(list(names)))


def matching_columns(df: DataFrame, patterns: Sequence[str]) -> list[str]:
    """Column names containing any pattern, in table order (P2, wide form)."""
    return [c for c in df.columns if any(p in c for p in patterns)]


def select_matching(df: DataFrame, patterns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project the matching columns (P2) -- column pruning reaches the scan."""
    return df.select(*[F.col(f"`{c}`") for c in [*keep, *matching_columns(df, patterns)]])


def where_matching(long: DataFrame, col: str, patterns: Sequence[str]) -> DataFrame:
    """Long form of P2: rows whose ``col`` contains any pattern."""
    cond = None
    for p in patterns:
        c = F.col(col).contains(p)
        cond = c if cond is None else (cond | c)
    return long.where(cond)


def nested_value(col: str, field: str = "value") -> Column:
    """Pull ``value`` from a nested struct/map cell and cast to double."""
    return F.col(col).getField(field).cast("double")


def coerce_ts(df: DataFrame, col: str = "ts", lenient: bool = False, fmt: str | None = None) -> DataFrame:
    """Timestamp coercion.

    Strict: a bad value fails the job (ANSI cast).  Lenient: bad values become
    NULL (``try_to_timestamp``) and those rows are dropped.
    """
    c = F.col(col)
    if not lenient:
        conv = F.to_timestamp(c, fmt) if fmt else c.cast("timestamp")
        return df.withColumn(col, conv.cast("timestamp_ntz"))
    conv = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return df.withColumn(col, conv.cast("timestamp_ntz")).dropna(subset=[col])


def time_range(df: DataFrame, lo, hi, ts: str = "ts") -> DataFrame:
    """Both ends inclusive (P7); a literal range is pushed into the Parquet scan."""
    lo_c, hi_c = ts_lit(lo), ts_lit(hi)
    return df.where((F.col(ts) >= lo_c) & (F.col(ts) <= hi_c))


def lookback(end, start=None, minutes: int = 100) -> tuple[Column, Column]:
    """Default look-back window: ``start`` or ``end - minutes`` (P10)."""
    end_c = ts_lit(end)
    start_c = ts_lit(start)
    return F.coalesce(start_c, end_c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))), end_c


def where_equal(df: DataFrame, **eq) -> DataFrame:
    """Conjunction of equality filters."""
    cond = None
    for k, v in eq.items():
        c = F.col(k) == F.lit(v)
        cond = c if cond is None else (cond & c)
    return df.where(cond) if cond is not None else df


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def localize(df: DataFrame, col: str = "ts", tz: str = "Europe/Helsinki", strict: bool = False,
             name: str | None = None) -> DataFrame:
    """Attach a zone to naive local times -> UTC instant.

    Spark shifts times in a DST gap forward and picks one side of an overlap
    silently.  ``strict`` raises on both, like a strict localisation:
    a gap time does not survive the round trip, and an overlap time maps back
    to itself from an instant one hour earlier or later as well.
    """
    out = name or col
    local = F.col(col).cast("timestamp_ntz")
    utc = F.to_utc_timestamp(local.cast("timestamp"), tz)
    if strict:
        back = F.from_utc_timestamp(utc, tz).cast("timestamp_ntz")
        hour = F.make_dt_interval(F.lit(0), F.lit(1))
        earlier = F.from_utc_timestamp(utc - hour, tz).cast("timestamp_ntz")
        later = F.from_utc_timestamp(utc + hour, tz).cast("timestamp_ntz")
        bad = (back != local) | (earlier == local) | (later == local)
        utc = F.when(bad, F.raise_error(F.concat(F.lit("non-existent or ambiguous local time "),
                                                 local.cast("string")))).otherwise(utc)
    return df.withColumn(out, utc)


def require_rows(df: DataFrame, k: int, what: str = "rows") -> None:
    """Raise unless the frame has at least ``k`` rows; reads at most ``k``."""
    n = df.limit(k).count()
    if n < k:
        raise ValueError(f"need at least {k} {what}, found {n}")


def sufficiency(df: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one per value of ``by``: count, min_required, sufficient."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).select(
        *by, "n_rows", F.lit(k).alias("min_required"), (F.col("n_rows") >= k).alias("sufficient"))


def require_nonempty(df: DataFrame, what: str = "dataset") -> None:
    """Raise on an empty frame."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
