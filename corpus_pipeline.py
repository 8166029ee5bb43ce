"""The corpus pipeline: documents in, packed training sequences out. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.llm import decontamination, jaccard, packing, pii, quality
from quaero.llm.arrow import BATCH, ROWS, small_batches
from quaero.llm.common import new_folder, read_documents, read_labels


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned ones reject go.

    Their texts go to Python ROWS at a time. That is settled when the result is written, so the session keeps the setting;
    ``run`` gives the former one back.
    """
    spark.conf.set(BATCH, str(ROWS))
    return quality.keep_good(docs, read_labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the smallest number."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    keyed = docs.select(F.struct("doc_id", jaccard.text_digest().alias("digest")).alias("doc_id"), "text")
    found = decontamination.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return jaccard.without_rows(docs, found.filter("contaminated").select("doc_id.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind, and n_chars, where there is one, is that of the new text."""
    masked = pii.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

# The learned rules have no SQL form; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps is written to the shared folder and read again."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        with small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
