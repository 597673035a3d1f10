"""Columns made in Python beside columns that pass through untouched."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


#: Rows of an Arrow batch at most, so that a batch of long texts stays small in a worker.
BATCH_ROWS = 2000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def give_back() -> None:
    """Return freed memory of this process to the system.

    Python workers are kept for later tasks; without this each keeps the memory of its
    largest task while it waits.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS; a lower setting stays."""
    if not 0 < int(spark.conf.get(BATCH_CONF, "10000")) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def add_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, Sequence[Any]]], added: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` less ``drop`` with the columns of ``added`` (a DDL schema) from ``make``.

    ``make`` gets each Arrow batch (of BATCH_ROWS rows at most) and returns the new columns; all others stay in Arrow, so
    no type and no null is changed on the way. A new column replaces one of its name.
    """
    bound_batches(df.sparkSession)
    new = StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in new.names]
    types = {f.name: to_arrow_type(f.dataType) for f in new.fields}
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns += [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], types[n], from_pandas=False) for n in types]
            yield pa.RecordBatch.from_arrays(columns, [*names, *types])
            del columns, made
        give_back()

    return df.mapInArrow(run, StructType([*kept, *new.fields]))
