"""Element-wise aggregates of vectors, combined map-side one buffer per key and task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _summarize(df: DataFrame, keys: Sequence[str], vector: str, metric) -> DataFrame:
    known = df.filter(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector)))
    return known.groupBy(*keys).agg(
        vector_to_array(metric(F.col("_v"))).alias(vector), F.count("*").alias("n")
    )


def sum_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    return _summarize(df, keys, vector, Summarizer.sum)


def avg_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    return _summarize(df, keys, vector, Summarizer.mean)
