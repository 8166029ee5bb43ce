"""The registered queries of this subpackage, each over its whole table, with the SQL that must agree where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.llm import (
    decontamination, hard_negatives, jaccard, licenses, packing, periodic_runs, pii, quality, sharding, simhash, sql, token_counts,
    token_files, toxicity,
)
from quaero.llm.common import read_documents, read_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return register


@query("op1_decontamination", sql.DECONTAMINATION)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op3_license_scan", sql.LICENSES)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_documents(spark, sf_dir))


@query("op5_sharding", sql.SHARDING)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_documents(spark, sf_dir), sharding.QUERY_BYTES)


@query("op6_pii", sql.PII)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_documents(spark, sf_dir))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_documents(spark, sf_dir))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_documents(spark, sf_dir))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read_documents(spark, sf_dir), read_labels(spark, sf_dir))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(read_documents(spark, sf_dir), read_labels(spark, sf_dir))


@query("op7_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.with_planted_runs(read_documents(spark, sf_dir)))


@query("op12_hard_negatives", sql.HARD_NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives.mine(hard_negatives.with_shifted_labels(rows), F.col("vec_id") % 50 == 0)


@query("op13_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir))
