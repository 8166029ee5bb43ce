"""Stored tables: pages, vectors, sinks for the index, the search log and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.functions.vectors import parse_vector


def read_table(spark: SparkSession, folder: str, name: str, spread_by: Sequence[str] = ()) -> DataFrame:
    """A stored table.

    A file with a single row group is read by a single task. Where costly text
    expressions follow, ``spread_by`` lays its rows out over all cores first; a
    table that already comes in as many pieces is left as it is.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if not spread_by or table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores, *spread_by)


def fetched_pages(pages: DataFrame, status: Column | int = 200, content_type: Column | str = "text/html") -> DataFrame:
    """Stored pages as fetch results: ``(page_id, url, final_url, status, content_type, html)``."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return pages.select(
        "page_id", "url", F.col("url").alias("final_url"), as_column(status).alias("status"),
        as_column(content_type).alias("content_type"), "html",
    )


def parse_embeddings(chunks: DataFrame, dims: int | None = None) -> DataFrame:
    """``(chunk_id, embedding)`` from vectors stored as JSON; null and empty ones are skipped."""
    parsed = chunks.select("chunk_id", parse_vector(F.col("embedding")).alias("embedding")).filter("embedding is not null")
    return parsed if dims is None else parsed.filter(F.size("embedding") == dims)


def write_index(path: str, documents: DataFrame, chunks: DataFrame, changes: DataFrame | None = None,
                postings: DataFrame | None = None, buckets: int = 64) -> None:
    """Documents and chunks are replaced, changes appended; postings lie in term buckets,
    so that a search for given terms reads only their buckets."""
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    if changes is not None:
        changes.write.mode("append").parquet(f"{path}/changes")
    if postings is not None:
        placed = postings.withColumn("bucket", term_bucket("term", buckets))
        placed.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(f"{path}/postings")


def term_bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def read_postings(spark: SparkSession, path: str, terms: DataFrame, buckets: int = 64) -> DataFrame:
    """Postings of the given terms; the bucket join prunes folders at run time."""
    wanted = terms.select("term").distinct().withColumn("bucket", term_bucket("term", buckets))
    return spark.read.parquet(f"{path}/postings").join(wanted, ["bucket", "term"], "left_semi").drop("bucket")


def search_log_rows(queries: DataFrame, results: DataFrame, logged_at: Column) -> DataFrame:
    """``(query_id, query, language, result_count, created_at)``: one row per query, also without results."""
    per = results.groupBy("query_id").agg(F.count("*").alias("result_count"))
    return queries.join(per, "query_id", "left").select(
        "query_id", F.col("question").alias("query"), T.majority_language("question").alias("language"),
        F.coalesce("result_count", F.lit(0)).alias("result_count"), logged_at.alias("created_at"),
    )


def append_search_log(path: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(path)


def write_json_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
