"""Stored vectors in cells with compressed residuals: the approximate search that a hybrid search can use.

Unit vectors go to their nearest centre. What is left of a vector after its centre is taken off is cut into parts, and each part
is stored as the number of its nearest code word (a byte). A query looks its inner products with centres and code words up in
small tables, keeps its best candidates of the nearest cells, and those alone are scored from the vectors themselves.

Centres and code words are learnt from at most ``SAMPLE`` vectors, the first by a hash of their number; everything is indexed.
Into how many parts a vector is cut follows from that sample: the fewest with which the candidates that its share of all rows
would get hold the nearest rows. At the most, each component is a part of its own.
How many cells a query opens at first follows from that sample, too: the fewest that give its vectors the recall asked for. Then
a query opens whatever other cell may hold a better row: one whose centre is nearer than its k-th distance so far and the radius
within which REACH of the cell's rows lie. The exact way is ``dense.dense_topk`` over ``vectors()``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.operators.dense import TIED, first_by_score
from quaero.session import cut_lineage

SAMPLE, TURNS, SEED = 16_384, 12, 11
PARTS, WORDS = 8, 256
# Candidates of a query that are scored from their vectors, for each row asked for.
RERANKED = 12
# Values of the query vectors that tasks hold at a time: 8 MB.
QUERY_VALUES = 1 << 20
TARGET, REACH = 0.95, 0.95
# Of the rows that the sample's own rows are nearest to, how many the candidates must hold.
HELD, SLACK = 0.99, 1e-12
SCORED = "query_id long, chunk_id long, score double"


def unit_rows(column: pd.Series, width: int) -> np.ndarray:
    """Rows at length one; rows of another width, without length or not finite are all NaN."""
    out = np.full((len(column), width), np.nan)
    for i, values in enumerate(column):
        if values is not None and len(values) == width:
            out[i] = values
    with np.errstate(invalid="ignore", divide="ignore"):
        lengths = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where((lengths > 0) & np.isfinite(lengths), lengths, np.nan)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * (rows @ centres.T)).argmin(axis=1)


def centres_of(rows: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``n`` centres of ``rows``; one that loses its rows starts again from the row that fits worst."""
    centres = rows[rng.permutation(len(rows))[:n]].copy()
    for _ in range(TURNS):
        own = nearest(rows, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            far = ((rows - centres[own]) ** 2).sum(axis=1).argsort()[::-1]
            centres[empty] = rows[far[: len(empty)]]
    return centres


@dataclass
class Quantizer:
    """Centres (cells x width) and the code words of each part (parts x words x width of a part)."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    @classmethod
    def learn(cls, rows: np.ndarray, cells: int, parts: int = PARTS, words: int = WORDS, centres: np.ndarray | None = None) -> Quantizer:
        rng = np.random.default_rng(SEED)
        centres = centres_of(rows, cells, rng) if centres is None else centres
        # Widths that do not divide are filled up with zeros.
        rest = cls._parts(rows - centres[nearest(rows, centres)], parts)
        found = [centres_of(part, words, rng) for part in rest]
        return cls(centres, np.stack([np.pad(w, ((0, words - len(w)), (0, 0)), constant_values=np.inf) for w in found]))

    @staticmethod
    def _parts(rows: np.ndarray, parts: int) -> np.ndarray:
        size = -(-rows.shape[1] // parts)
        padded = np.pad(rows, ((0, 0), (0, size * parts - rows.shape[1])))
        return padded.reshape(len(rows), parts, size).transpose(1, 0, 2)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its code, a byte a part."""
        cell = nearest(rows, self.centres)
        code = np.zeros((len(rows), len(self.words)), dtype=np.uint8)
        for p, part in enumerate(self._parts(rows - self.centres[cell], len(self.words))):
            code[:, p] = nearest(part, np.where(np.isfinite(self.words[p]), self.words[p], 1e150))
        return cell, code

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of queries with centres, and with the code words of each part (queries x parts x words)."""
        parts = self._parts(queries, len(self.words))
        words = np.where(np.isfinite(self.words), self.words, 0)
        return queries @ self.centres.T, np.einsum("pqs,pws->qpw", parts, words)

    def estimates(self, tables: tuple[np.ndarray, np.ndarray], query: int, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        with_centres, with_words = tables
        return with_centres[query, cell] + with_words[query, np.arange(code.shape[1])[None, :], code].sum(axis=1)


    def recall(self, rows: np.ndarray, k: int, candidates: int) -> float:
        """The share of the nearest ``k`` rows of some of ``rows`` that is among the best ``candidates`` by estimate."""
        k, candidates = min(k, len(rows)), min(candidates, len(rows))
        asked = rows[:: max(1, len(rows) // 256)][:256]
        (cell, code), tables, found = self.encode(rows), self.tables(asked), 0
        for i, scores in enumerate(asked @ rows.T):
            best = np.argpartition(-self.estimates(tables, i, cell, code), candidates - 1)[:candidates]
            found += min(k, int((scores[best] >= np.partition(scores, -k)[-k] - SLACK).sum()))
        return found / (k * len(asked))


@dataclass
class QuantizedIndex:
    """The index in folder ``path``: ``codes`` by cell, ``vectors`` by number, and the quantizer."""

    spark: SparkSession
    path: str
    quantizer: Quantizer
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, parts: int = PARTS, k: int = 18,
              target: float = TARGET) -> QuantizedIndex:
        """Learn from a sample of ``vectors`` (chunk_id, embedding), write all of them; ``parts`` at least."""
        spark = vectors.sparkSession
        known = vectors.select("chunk_id", "embedding").filter(F.size("embedding") > 0)
        width, n = known.agg(F.mode(F.size("embedding"), deterministic=True), F.count("*")).first()
        width = width or 1
        picked = known.filter(F.size("embedding") == width).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").toPandas()
        rows = unit_rows(picked["embedding"], width)
        rows = rows[~np.isnan(rows).any(axis=1)]
        rows = rows if len(rows) else np.eye(1, width)
        quantizer = Quantizer.learn(rows, cells or max(1, min(len(rows) // 8, int(2 * np.sqrt(len(rows))))), parts)
        candidates = max(k, k * RERANKED * len(rows) // max(1, n))
        while parts < width and quantizer.recall(rows, k, candidates) < HELD:
            parts = min(width, parts * 2)
            quantizer = Quantizer.learn(rows, len(quantizer.centres), parts, centres=quantizer.centres)
        index = cls(spark, path, quantizer, len(quantizer.centres))
        index.probes = index._fewest_probes(rows, k, target)
        table = [("centres", quantizer.centres.shape, quantizer.centres), ("words", quantizer.words.shape, quantizer.words),
                 ("probes", (1,), np.array([index.probes]))]
        lines = [(name, list(shape), np.asarray(values, dtype=np.float64).ravel().tolist()) for name, shape, values in table]
        spark.createDataFrame(lines, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/quantizer")
        index.add(known, 1)
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantizedIndex:
        rows = {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/quantizer").collect()}
        return cls(spark, path, Quantizer(rows["centres"], rows["words"]), int(rows["probes"][0]))

    def _fewest_probes(self, rows: np.ndarray, k: int, target: float) -> int:
        """The fewest cells whose rows hold ``target`` of the nearest ``k`` of some of the sample's own rows."""
        asked = rows[:: max(1, len(rows) // 256)][:256]
        own = nearest(rows, self.quantizer.centres)
        scores = asked @ rows.T
        best = np.argpartition(-scores, min(k, len(rows) - 1), axis=1)[:, :k]
        place = np.argsort(np.argsort(-(asked @ self.quantizer.centres.T), axis=1, kind="stable"), axis=1, kind="stable")
        needed = np.sort(place[np.arange(len(asked))[:, None], own[best]].ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1

    def add(self, vectors: DataFrame, segment: int) -> None:
        """Index ``vectors`` as one segment; writing it again replaces it."""
        shared = self.spark.sparkContext.broadcast(self.quantizer)

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            quantizer = shared.value
            for batch in batches:
                rows = unit_rows(batch["embedding"], quantizer.width)
                known = ~np.isnan(rows).any(axis=1)
                cell, code = quantizer.encode(rows[known])
                far = np.sqrt(((rows[known] - quantizer.centres[cell]) ** 2).sum(axis=1))
                yield pd.DataFrame({"chunk_id": batch["chunk_id"][known], "code": [c.tobytes() for c in code], "far": far, "cell": cell})

        known = vectors.select("chunk_id", "embedding").filter(F.size("embedding") > 0)
        known.write.mode("overwrite").parquet(f"{self.path}/vectors/segment={segment}")
        written = self.spark.read.schema("chunk_id long, embedding array<float>").parquet(f"{self.path}/vectors/segment={segment}")
        codes = written.mapInPandas(encode, "chunk_id long, code binary, far float, cell int")
        # Common cells are spread over several files, rare ones share a task.
        codes.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(
            f"{self.path}/codes/segment={segment}"
        )
        stored = self.spark.read.schema("far float, cell int").parquet(f"{self.path}/codes/segment={segment}")
        radii = stored.groupBy("cell").agg(F.percentile_approx("far", REACH).alias("radius"))
        radii.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/radii/segment={segment}")

    def remove(self, chunks: DataFrame, segment: int) -> None:
        """Take ``chunks`` (chunk_id) out of all segments before this one."""
        chunks.select("chunk_id").write.mode("overwrite").parquet(f"{self.path}/gone/segment={segment}")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # only a part that is not there yet is empty
                raise
            return self.spark.createDataFrame([], schema)

    def _alive(self, rows: DataFrame) -> DataFrame:
        gone = self._read("gone", "chunk_id long, segment long").groupBy(F.col("chunk_id").alias("_gone")).agg(F.max("segment").alias("_by"))
        return rows if gone.isEmpty() else rows.join(
            gone, (F.col("chunk_id") == F.col("_gone")) & (F.col("segment") < F.col("_by")), "left_anti"
        )

    def vectors(self) -> DataFrame:
        """``(chunk_id, embedding)`` of all that is indexed."""
        return self._alive(self._read("vectors", "chunk_id long, embedding array<float>, segment long")).drop("segment")

    def topk(self, queries: DataFrame, k: int = 18, probes: int | None = None, reranked: int = RERANKED) -> DataFrame:
        """``(query_id, chunk_id, score, rank)``: the best ``k`` by cosine of the ``probes`` nearest cells.

        Queries (query_id, embedding) of another width than the index find nothing. They are met in blocks of a proven size;
        each task gives out its best candidates per query, and the candidates alone meet their vectors. Without ``probes``, the
        cells that may hold better rows than those found first are opened, too.
        """
        width = self.quantizer.width
        asked = cut_lineage(queries.select("query_id", "embedding").filter(F.size("embedding") == width))
        blocks = max(1, -(-asked.count() * width // (QUERY_VALUES // 2)))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        found = None
        for b in range(blocks):
            some = self._block_topk(asked.filter(block == b), k, probes, reranked)
            found = some if found is None else found.unionByName(some)
        return first_by_score(found, k)

    def _block_topk(self, asked: DataFrame, k: int, probes: int | None, reranked: int) -> DataFrame:
        """The rows of one block of queries, scored from their vectors; at least the best ``k`` that were found."""
        part = asked.toPandas()
        rows = unit_rows(part["embedding"], self.quantizer.width)
        known = ~np.isnan(rows).any(axis=1)
        ids, rows = part["query_id"].to_numpy()[known], rows[known]
        order = np.argsort(-(rows @ self.quantizer.centres.T), axis=1, kind="stable")
        opened = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(opened, order[:, : probes or self.probes], True, axis=1)
        first = self._scored(self._candidates(ids, rows, opened, k * reranked), asked, k, reranked)
        if probes or opened.all():
            return first
        first = cut_lineage(first)
        radii = {r["cell"]: r["radius"] for r in self._read("radii", "cell int, radius float, segment long").groupBy("cell").agg(F.max("radius").alias("radius")).collect()}
        radius = np.array([radii.get(c, -np.inf) for c in range(len(self.quantizer.centres))])
        last = {r["query_id"]: r["score"] for r in first_by_score(first, k).filter(F.col("rank") == k).collect()}
        # Unit vectors: the distance of two follows from their cosine. Fewer than k rows so far: every cell may hold one.
        limit = np.array([np.sqrt(max(0.0, 2 - 2 * last[q])) if q in last else np.inf for q in ids.tolist()])
        apart = np.sqrt(np.maximum(0, 1 + (self.quantizer.centres**2).sum(axis=1)[None, :] - 2 * rows @ self.quantizer.centres.T))
        more = ~opened & (apart - radius[None, :] <= limit[:, None])
        second = self._scored(self._candidates(ids, rows, more, k * reranked), asked, k, reranked)
        return first.unionByName(second)

    def _scored(self, found: DataFrame, asked: DataFrame, k: int, reranked: int) -> DataFrame:
        """Candidates with the cosine of their vectors."""
        width = self.quantizer.width
        candidates = first_by_score(found, k * reranked).select("query_id", "chunk_id")
        pairs = candidates.join(self.vectors().withColumnRenamed("embedding", "_vector"), "chunk_id").join(asked, "query_id")

        def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                a, b = unit_rows(batch["embedding"], width), unit_rows(batch["_vector"], width)
                yield pd.DataFrame({"query_id": batch["query_id"], "chunk_id": batch["chunk_id"], "score": np.round((a * b).sum(axis=1), TIED)})

        return pairs.mapInPandas(exact, SCORED).filter(~F.isnan("score"))

    def _candidates(self, ids: np.ndarray, rows: np.ndarray, opened: np.ndarray, most: int) -> DataFrame:
        """The ``most`` best rows by estimate for each query and task, of the cells that it opens."""
        tables = self.quantizer.tables(rows)
        by_cell = {c: np.flatnonzero(opened[:, c]) for c in np.flatnonzero(opened.any(axis=0)).tolist()}
        shared = self.spark.sparkContext.broadcast((self.quantizer, tables, by_cell, ids))

        def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            quantizer, tables, by_cell, ids = shared.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for cell, rows in batch.groupby("cell"):
                    code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
                    chunk = rows["chunk_id"].to_numpy()
                    for q in by_cell.get(int(cell), ()):
                        score = quantizer.estimates(tables, q, np.full(len(rows), cell), code)
                        kept = best.get(q)
                        all_ids, all_scores = (chunk, score) if kept is None else (np.append(kept[0], chunk), np.append(kept[1], score))
                        first = np.lexsort((all_ids, -all_scores))[:most]
                        best[q] = all_ids[first], all_scores[first]
            for q, (chunks, scores) in best.items():
                yield pd.DataFrame({"query_id": ids[q], "chunk_id": chunks, "score": scores})

        codes = self._alive(self._read("codes", "chunk_id long, code binary, segment long, cell int"))
        return codes.filter(F.col("cell").isin(list(by_cell))).select("chunk_id", "code", "cell").mapInPandas(estimate, SCORED)
