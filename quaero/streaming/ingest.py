"""Newly fetched pages into the stored corpus, batch by batch.

A batch is one segment of the corpus: it writes what it changes and nothing else. Run again after a failure, it reads the
segments before it and replaces its own.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quaero.plans.store import CorpusStore, SearchIndex
from quaero.sources.merge_table import STEP

FETCHED_SCHEMA = "page_id long, url string, final_url string, status int, content_type string, html string"
FILES_PER_BATCH = 16


def current_documents(spark: SparkSession, path: str) -> DataFrame:
    return CorpusStore(spark, path).documents.current()


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    return CorpusStore(spark, path).chunks.current()


def ingest_stream(spark: SparkSession, landing: str, path: str, checkpoint: str, index: SearchIndex | None = None,
                  files_per_batch: int = FILES_PER_BATCH) -> StreamingQuery:
    """Read everything that has landed, then stop; the search index follows if one is given."""
    pages = spark.readStream.schema(FETCHED_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(landing)

    def apply(batch: DataFrame, batch_id: int) -> None:
        now = datetime.datetime.now(datetime.timezone.utc)
        CorpusStore(spark, path, index).ingest(batch, now, (batch_id + 1) * STEP)

    return (
        pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
