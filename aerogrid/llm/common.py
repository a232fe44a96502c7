"""Helpers shared by the operators: Arrow batch mapping and column spellings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from aerogrid.session import cut_lineage, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE_BYTES = 16 << 20   # text handled at once inside a task


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def distinct_words(text: Column) -> Column:
    """Distinct runs of letters a-z and digits, A-Z lower-cased."""
    # a split costs a quarter of extracting every match; only its ends can be empty
    return F.array_remove(F.array_distinct(F.split(ascii_lower(text), "[^a-z0-9]+")), "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column has it
    (Spark's column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_slices(batch: pa.RecordBatch, text_index: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes (one row at
    least), so that long texts do not add up in a Python worker."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


class _Append:
    """mapInArrow body: kept columns as they came, then computed ones.

    ``factory()`` is called once a task and returns ``compute(texts) ->
    [arrays]``, so caches live as long as the task."""

    def __init__(self, factory: Callable, text_index: int, keep: list[int], names: list[str], limit: int):
        self.factory, self.text_index, self.keep, self.names, self.limit = factory, text_index, keep, names, limit

    def __call__(self, batches):
        compute = self.factory()
        for batch in batches:
            for part in bounded_slices(batch, self.text_index, self.limit):
                new = compute(part.column(self.text_index))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in self.keep] + list(new), names=self.names)


def append_computed(df: DataFrame, text_col: str, factory: Callable, fields: list[StructField],
                    keep: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """Columns ``keep`` of ``df`` (all by default) and the computed ``fields``,
    row by row in Arrow batches; no shuffle."""
    ship_package(df.sparkSession)
    keep = df.columns if keep is None else keep
    index = [df.columns.index(c) for c in keep]
    schema = StructType([df.schema.fields[i] for i in index] + fields)
    return df.mapInArrow(_Append(factory, df.columns.index(text_col), index, schema.names, limit), schema)


class _Where:
    """mapInArrow body: the rows whose text ``accept(texts)`` marks true."""

    def __init__(self, factory: Callable, text_index: int):
        self.factory, self.text_index = factory, text_index

    def __call__(self, batches):
        accept = self.factory()
        for batch in batches:
            for part in bounded_slices(batch, self.text_index):
                yield part.filter(accept(part.column(self.text_index)))


def filter_texts(df: DataFrame, text_col: str, factory: Callable) -> DataFrame:
    """The rows of ``df`` that ``factory()(texts)`` accepts, all columns kept."""
    ship_package(df.sparkSession)
    return df.mapInArrow(_Where(factory, df.columns.index(text_col)), df.schema)


def land(df: DataFrame, name: str) -> DataFrame:
    """Written once under the shared checkpoint folder and read back."""
    return cut_lineage(df, name)
