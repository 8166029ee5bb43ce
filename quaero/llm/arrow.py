"""Record batches in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Rows that a task takes at a time, so that its memory does not follow the size of Spark's batches.
ROWS = 500
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a job of ours runs, Spark hands out batches of ROWS rows; then the session's own setting holds again."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow``; Spark holds its batches under 64 MB, and ``function`` goes through them in slices of ROWS rows."""
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
    batch = None
    give_back()


def give_back() -> None:
    """What Arrow holds for later batches goes back to the system, as a worker outlives its task."""
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column of texts as UTF-8; null is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.large_binary()).to_pylist()]
