"""aerogrid: hourly sensor-network analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    readers, document decoding, sinks
functions  column-level scalar helpers (pure ``pyspark.sql.functions``)
operators  projections, joins, aggregates, windows, ordering
plans      composed jobs: samples, Lasso fit/predict, registry, forecast
streaming  incremental ingest with Structured Streaming
"""

__version__ = "0.1.0"
