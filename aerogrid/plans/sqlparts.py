"""SQL building blocks for the DuckDB oracle (test-bed views in SQL)."""

from __future__ import annotations

from aerogrid import constants as K
from aerogrid.sources.testbed import OBS_SQL, STATIONS_SQL

SERIES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{s[0]}', '{ind}')" for s in K.TESTBED_STATIONS for ind in K.INDICATORS
) + ") AS t(station, indicator)"

DEDUP_SQL = f"""
SELECT station, indicator, ts, value, units, chunk_no, seq FROM ({OBS_SQL}) o
QUALIFY row_number() OVER (PARTITION BY station, indicator, ts ORDER BY chunk_no, seq) = 1
"""

def grid_sql(src: str) -> str:
    return f"""
SELECT s.station, s.indicator, t.ts, d.value
FROM (SELECT DISTINCT ts FROM ({src}) x) t
CROSS JOIN ({SERIES_SQL}) s
LEFT JOIN ({src}) d ON d.station = s.station AND d.indicator = s.indicator AND d.ts = t.ts
"""


def filled_sql(grid: str) -> str:
    return f"""
SELECT station, indicator, ts,
       coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY station, indicator ORDER BY ts
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(value IGNORE NULLS) OVER (PARTITION BY station, indicator ORDER BY ts
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value,
       value IS NULL AS is_filled
FROM ({grid}) g
"""


GRID_SQL = grid_sql(DEDUP_SQL)
FILLED_SQL = filled_sql(GRID_SQL)

# what a prediction run loads: the last hours alone, filled among themselves
RECENT_GRID_SQL = grid_sql(f"""SELECT * FROM ({DEDUP_SQL}) r
WHERE ts > (SELECT max(ts) FROM ({DEDUP_SQL}) m) - INTERVAL {K.PREDICT_WINDOW_HOURS} HOUR""")
RECENT_SQL = filled_sql(RECENT_GRID_SQL)


def r6(expr: str) -> str:
    """Rounded double, with -0.0 folded to 0.0."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def wide_sql(src: str) -> str:
    cols = ", ".join(
        f"max(CASE WHEN station = '{s[0]}' AND indicator = '{ind}' THEN value END) AS \"{ind}_{s[0]}\""
        for s in K.TESTBED_STATIONS for ind in K.INDICATORS)
    return f"SELECT ts, {cols} FROM ({src}) w GROUP BY ts"


def norm_sql(expr: str) -> str:
    """SQL twin of ``normalise_pollutant``."""
    return (f"replace(replace({expr}, '{K.PM_LONG_PREFIX}', '{K.PM_SHORT_PREFIX}'), "
            f"'{K.MICRON_SUFFIX}', '')")


def hist_sql(T: int = K.TRAINING_HOURS) -> str:
    """SQL twin of ``history``: last T grid timestamps, hour_1 = oldest."""
    return f"""
SELECT f.indicator || '_' || f.station AS feature, {norm_sql('f.indicator')} AS pollutant,
       f.station AS station, 'hour_' || CAST({T + 1} - t.rn AS VARCHAR) AS hour,
       f.ts AS timestamp, f.value AS value
FROM ({RECENT_SQL}) f
JOIN (SELECT ts, row_number() OVER (ORDER BY ts DESC) AS rn
      FROM (SELECT DISTINCT ts FROM ({RECENT_GRID_SQL}) g0) d) t ON f.ts = t.ts
WHERE t.rn <= {T}
"""


HIST_SQL = hist_sql()
