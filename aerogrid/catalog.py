"""Registered queries: one per operator of the inventory, each with its
DuckDB oracle SQL where SQL can express it.

Every query reads the driver tables under ``sf_dir`` (or data Spark derives
from them) in full.  Oracle conventions: session zone UTC; computed doubles
rounded to 6 decimals in both spellings; no arrays or maps in outputs; every
computed column aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from aerogrid.plans import catalog_core, catalog_docs, catalog_fixed, catalog_io, catalog_model, catalog_more, catalog_ops  # noqa: F401
