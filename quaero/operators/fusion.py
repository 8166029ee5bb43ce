"""Merging ranked lists, reranking and the relative floor."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions.text import overlap, strip, text_or_empty
from quaero.operators.keyed import first_rows

RRF_CONSTANT = 60
CANDIDATES = 24
RERANK_CHARS = 800
MIN_KEPT_SCORE = 0.12
SHARE_OF_BEST = 0.45

Scorer = Callable[[Column, Column], Column]


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Both lists have (query_id, chunk_id, score, rank from 1), a pair once; ranks add up as 1/(60+rank).

    Ties go to the better dense rank, then to the better lexical one.
    """
    near = dense.select(
        "query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank")
    )
    said = lexical.select(
        "query_id", "chunk_id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank")
    )
    point = lambda c: F.coalesce(1.0 / (RRF_CONSTANT + F.col(c)), F.lit(0.0))
    both = near.join(said, ["query_id", "chunk_id"], "full")
    return both.withColumn("rrf", point("dense_rank") + point("lexical_rank"))


def candidates(fused: DataFrame, n: int = CANDIDATES) -> DataFrame:
    order = [
        F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), F.asc("chunk_id"),
    ]
    return first_rows(fused, ["query_id"], order, n, "pos")


def passage(title: Column | str, content: Column | str) -> Column:
    return F.concat(
        strip(text_or_empty(title)), F.lit("\n"), F.substring(text_or_empty(content), 1, RERANK_CHARS)
    )


def rerank(hits: DataFrame, k: int, scorer: Scorer = overlap) -> DataFrame:
    """Score (question, title and first 800 characters) and keep the best ``2k`` per query.

    ``scorer`` maps two columns to one; the default stays in built-in
    expressions, a model can be given as a pandas UDF.
    """
    scored = hits.withColumn(
        "rerank_score", scorer(F.col("question"), passage("document_title", "content"))
    )
    return first_rows(scored, ["query_id"], [F.desc("rerank_score"), F.asc("pos")], 2 * k, "pos_reranked")


def relative_floor(hits: DataFrame, k: int) -> DataFrame:
    """Hits near the best score of their query; the very best one always stays."""
    best = hits.groupBy("query_id").agg(F.max("rerank_score").alias("_best"))
    floor = F.greatest(F.lit(MIN_KEPT_SCORE), F.col("_best") * SHARE_OF_BEST)
    kept = hits.join(best, "query_id").filter(
        (F.col("rerank_score") >= floor) | (F.col("pos_reranked") == 1)
    )
    return first_rows(kept.drop("_best"), ["query_id"], [F.asc("pos_reranked")], k, "final_pos")


def merge_hits(lists: Sequence[DataFrame], limit: Column | int, keys: Sequence[str] = ("query_id",),
               order: str = "pos") -> DataFrame:
    """Ordered union of hit lists, one hit per document, the first wins; renumbers ``order``."""
    numbered = [d.withColumn("_list", F.lit(i)) for i, d in enumerate(lists)]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    keys = list(keys)
    position = [F.col("_list"), F.col(order), F.col("chunk_id")]
    one_each = first_rows(together, [*keys, "document_id"], position, 1)
    if isinstance(limit, int):
        ranked = first_rows(one_each, keys, position, limit, "_merged")
    else:
        from pyspark.sql.window import Window

        ranked = one_each.withColumn(
            "_merged", F.row_number().over(Window.partitionBy(*keys).orderBy(*position))
        ).filter(F.col("_merged") <= limit)
    return ranked.withColumn(order, F.col("_merged")).drop("_merged", "_list")
