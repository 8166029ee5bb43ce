"""Vector retrieval: exact top-k by cosine and cell-based approximate top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.functions import vectors as V
from quaero.operators.keyed import first_rows

# Query vectors held by every task: checked before they are sent.
MAX_BROADCAST_VALUES = 4_000_000
QUERIES_PER_BLOCK = 1_024
# Scores alike to so many places are ties: the last ones depend on the order in which products are summed.
TIED = 12
CHUNKS_PER_SHARD = 50_000


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows scaled to length one; a row of another width or of no length is all NaN."""
    out = np.full((len(column), width), np.nan)
    for i, values in enumerate(column):
        if values is not None and len(values) == width:
            out[i] = values
    lengths = np.sqrt((out * out).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.where(lengths == 0, np.nan, lengths)


def _best(query_ids, queries: np.ndarray, chunk_ids, chunks: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's best ``k`` of these chunks, ties by chunk id."""
    scores = np.round(queries @ chunks.T, TIED)
    frames = []
    ids = np.asarray(chunk_ids)
    for query_id, row in zip(query_ids, scores):
        known = ~np.isnan(row)
        found_ids, found = ids[known], row[known]
        if len(found) > k:
            edge = np.partition(found, -k)[-k]
            keep = found >= edge
            found_ids, found = found_ids[keep], found[keep]
        order = np.lexsort((found_ids, -found))[:k]
        frames.append(
            pd.DataFrame({"query_id": query_id, "chunk_id": found_ids[order], "score": found[order]})
        )
    return pd.concat(frames) if frames else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})


SCORED = "query_id long, chunk_id long, score double"


def first_by_score(scored: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    return first_rows(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k, rank)


def _fits(queries: DataFrame, limit: int | None = None) -> list | None:
    """The query rows when their values are few enough to send to every task, else ``None``."""
    values = queries.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
    return queries.collect() if values <= (limit or MAX_BROADCAST_VALUES) else None


def dense_topk(
    queries: DataFrame, chunks: DataFrame, k: int = 18, broadcast_values: int | None = None
) -> DataFrame:
    """Exact cosine top-k: ``(query_id, chunk_id, score, rank)``, rank from 1.

    ``queries`` has (query_id, embedding), ``chunks`` (chunk_id, embedding);
    rows without a usable vector are left out, and a query meets the chunks of
    its own width. A query batch of a checked size
    goes to every task, which gives out only its k best per query, so the
    corpus itself is never shuffled. A larger batch is cut into
    blocks, the corpus into shards, and each block meets each shard once.
    """
    known = queries.select("query_id", "embedding").filter(F.size("embedding") > 0)
    corpus = chunks.select("chunk_id", "embedding").filter(F.size("embedding") > 0)
    fitting = _fits(known, broadcast_values)
    if fitting is None:
        return first_by_score(_blockwise(known, corpus, k), k)
    by_width: dict[int, list] = {}
    for row in fitting:
        by_width.setdefault(len(row["embedding"]), []).append(row)
    held = chunks.sparkSession.sparkContext.broadcast(
        [
            ([r["query_id"] for r in rows], _matrix(pd.Series([r["embedding"] for r in rows], dtype="object"), width))
            for width, rows in sorted(by_width.items())
        ]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            found = [] if kept is None else [kept]
            for ids, q in held.value if len(batch) else ():
                chunk_rows = _matrix(batch["embedding"], q.shape[1])
                for at in range(0, len(ids), QUERIES_PER_BLOCK):
                    found.append(_best(ids[at : at + QUERIES_PER_BLOCK], q[at : at + QUERIES_PER_BLOCK], batch["chunk_id"], chunk_rows, k))
            found = [f for f in found if len(f)]
            if found:
                kept = pd.concat(found).sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if kept is not None:
            yield kept

    return first_by_score(corpus.mapInPandas(score, SCORED), k)


def _blockwise(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Fragment and replicate: one bounded cell per query block and corpus shard."""
    blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    shards = max(1, -(-chunks.count() // CHUNKS_PER_SHARD))
    left = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))
    )
    right = chunks.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    )

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        parts = []
        for width, same in q.groupby(q["embedding"].map(len)):
            parts.append(
                _best(same["query_id"], _matrix(same["embedding"], width),
                      c["chunk_id"], _matrix(c["embedding"], width), k)
            )
        return pd.concat(parts)

    return (
        left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
        .applyInPandas(cell, SCORED)
    )


def nearest(chunks: DataFrame, query: list[float], k: int = 18) -> DataFrame:
    """One query vector against the corpus, entirely in built-in expressions."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.filter(F.col("embedding").isNotNull()).select(
        "chunk_id", V.cosine_similarity(F.col("embedding"), vector).alias("score")
    )
    return scored.filter("score is not null").orderBy(F.desc("score"), F.asc("chunk_id")).limit(k)


def with_documents(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Text and document columns for the few rows left after the limit."""
    texts = chunks.select("chunk_id", "document_id", "content", "page", "section")
    titles = documents.select(
        "document_id", F.col("title").alias("document_title"), F.col("url").alias("document_url")
    )
    return hits.join(texts, "chunk_id").join(titles, "document_id")


class CellIndex:
    """Chunks by their nearest centre: the approximate counterpart of ``dense_topk``.

    Centres are learnt from unit vectors, so squared distance orders as cosine
    does. A query reads its ``probes`` nearest cells only; with as many probes
    as cells the result is exact.
    """

    def __init__(self, centres: list[list[float]], assigned: DataFrame):
        self.centres = centres
        self.assigned = assigned

    @classmethod
    def build(cls, chunks: DataFrame, cells: int, seed: int = 7, sample: float = 1.0) -> CellIndex:
        unit = chunks.filter(F.size("embedding") > 0).withColumn("_unit", V.normalize(F.col("embedding")))
        rows = unit.withColumn("features", array_to_vector(F.col("_unit")))
        training = rows.sample(sample, seed=seed) if sample < 1 else rows
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(training.select("features"))
        centres = [c.tolist() for c in model.clusterCenters()]
        assigned = model.transform(rows).select(
            "chunk_id", "embedding", F.col("prediction").alias("cell")
        )
        return cls(centres, assigned)

    def save(self, path: str) -> None:
        """One folder per cell, so that probing reads only the folders it names."""
        self.assigned.write.mode("overwrite").partitionBy("cell").parquet(path)

    def probe(self, queries: DataFrame, probes: int) -> DataFrame:
        """``(query_id, embedding, cell)`` for each query's nearest cells."""
        centres = np.asarray(self.centres)
        lengths = (centres * centres).sum(axis=1)

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                q = _matrix(batch["embedding"], centres.shape[1])
                far = lengths[None, :] - 2 * (q @ centres.T)
                order = np.argsort(far, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(batch["query_id"].to_numpy(), order.shape[1]),
                        "embedding": batch["embedding"].repeat(order.shape[1]).to_list(),
                        "cell": order.ravel(),
                    }
                )

        known = queries.select("query_id", "embedding").filter(F.size("embedding") > 0)
        return known.mapInPandas(pick, "query_id long, embedding array<float>, cell int")

    def topk(self, queries: DataFrame, k: int = 18, probes: int = 4) -> DataFrame:
        """A hot cell is one join key with many rows on one side only, which skew
        handling splits; scores are worked out row by row and cut to k per task."""
        probed = self.probe(queries, probes).withColumnRenamed("embedding", "_query")
        scored = self.assigned.join(probed, "cell").select(
            "query_id", "chunk_id",
            V.cosine_similarity(F.col("embedding"), F.col("_query")).alias("score"),
        )
        return first_by_score(scored.filter("score is not null"), k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of each query's exact hits that the approximate search also found."""
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("_found"))
    return (
        exact.select("query_id", "chunk_id").join(found, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg((F.sum(F.coalesce("_found", F.lit(0))) / F.count("*")).alias("recall"))
    )
