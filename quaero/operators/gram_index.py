"""A stored substring index: which chunks hold a piece of one, two or three characters.

Chunks are dealt to cells; a block lists the chunks of one cell that hold one piece. A needle of up to three characters is a
piece and needs nothing else. A longer one meets the lists of its rarest pieces, cell by cell: cells that lack one are skipped,
the lists of the others are intersected, and only what is left is compared with the text itself. Needles are looked up once,
however many questions ask for them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.operators.keyed import first_rows, sent
from quaero.session import cut_lineage

LONGEST, CELL = 3, 1024
# Lists that are intersected for a needle: its rarest pieces.
LISTS = 6
# Candidates of a needle that are compared first, for each row asked for; the others follow only where these do not do.
AHEAD = 8
SCHEMA = "gram string, cell int, n int, ids array<bigint>, segment long, bucket int"


# Characters of a text that are cut into pieces at a time, and bits of a character.
BLOCK, BITS = 1 << 20, 21


def _pieces(needle: Column, size: Column) -> Column:
    """The distinct pieces of ``size`` characters of a needle that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(needle) - size + 1), lambda i: F.substr(needle, i, size)))


def _grams(text: bytes, n: int) -> np.ndarray:
    """The distinct pieces of ``n`` characters of a text (UTF-8), each as a number."""
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64)
    found = []
    for at in range(0, max(0, len(codes) - n + 1), BLOCK):
        some = codes[at : at + BLOCK + n - 1]
        key = np.zeros(len(some) - n + 1, dtype=np.int64)
        for i in range(n):
            key = key << BITS | some[i : i + len(key)]
        found.append(np.unique(key))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def _cell_blocks(cell: pa.Table) -> pa.Table:
    """The blocks of one cell, from the texts of its chunks."""
    cell = cell.sort_by("chunk_id")
    ids = cell.column("chunk_id").to_numpy()
    texts = [t or b"" for t in cell.column("_low").cast(pa.large_binary()).to_pylist()]
    number, parts = cell.column("cell")[0].as_py(), []
    for n in range(1, LONGEST + 1):
        grams = [_grams(t, n) for t in texts]
        key = np.concatenate(grams)
        owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        order = np.argsort(key, kind="stable")
        known, first, counts = np.unique(key[order], return_index=True, return_counts=True)
        codes = np.stack([known >> BITS * (n - 1 - i) & (1 << BITS) - 1 for i in range(n)], axis=1).astype("<u4")
        joined = codes.tobytes().decode("utf-32-le")
        parts.append(pa.table({
            "gram": pa.array([joined[i : i + n] for i in range(0, len(joined), n)], pa.string()),
            "cell": pa.array(np.full(len(known), number), pa.int32()), "n": pa.array(counts, pa.int32()),
            "ids": pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(ids[owner[order]], pa.int64())),
        }))
    return pa.concat_tables(parts)


@dataclass
class GramIndex:
    """The index in folder ``path``; chunks are (chunk_id, content), compared in lower case."""

    spark: SparkSession
    path: str
    buckets: int = 32

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int").alias("bucket")

    def add(self, chunks: DataFrame, segment: int = 1) -> None:
        """Index ``chunks`` as one segment; writing it again replaces it."""
        cells = max(1, -(-chunks.count() // CELL))
        cell = F.pmod(F.xxhash64("chunk_id"), F.lit(cells)).cast("int").alias("cell")
        # Texts go to the task of their cell, which lays out its blocks in place: a shuffled row is a text or a block, never a piece.
        dealt = chunks.select("chunk_id", cell, F.lower("content").alias("_low"))
        blocks = dealt.groupBy("cell").applyInArrow(_cell_blocks, "gram string, cell int, n int, ids array<bigint>")
        placed = blocks.select("gram", "cell", "n", "ids", self._bucket())
        ordered = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "cell")
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/segment={segment}")

    def _blocks(self, grams: DataFrame) -> DataFrame:
        """The blocks in the folders of the given pieces: ``buckets`` of them at most."""
        folders = [r[0] for r in grams.select(self._bucket()).distinct().collect()]
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # an index without segments is empty
                raise
            rows = self.spark.createDataFrame([], SCHEMA)
        return rows.filter(F.col("bucket").isin(folders))

    def candidates(self, needles: DataFrame) -> DataFrame:
        """``(needle, chunk_id)`` of the chunks that hold the rarest pieces of a needle: all that hold the needle are among them.

        ``needles`` has distinct (needle), in lower case; an empty one stands in no text.
        """
        size = F.least(F.length("needle"), F.lit(LONGEST))
        some = needles.filter(F.length("needle") > 0)
        asked = cut_lineage(some.select("needle", F.explode(_pieces(F.col("needle"), size)).alias("gram")))
        blocks = self._blocks(asked).join(sent(asked.select("gram").distinct()), "gram", "left_semi")
        counts = blocks.select("gram", "n").groupBy("gram").agg(F.sum("n").alias("n"))
        # A piece that no chunk has is the rarest, and leaves the needle without a full cell.
        known = asked.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rarest = cut_lineage(first_rows(known, ["needle"], [F.asc("n"), F.asc("gram")], LISTS).select("needle", "gram"))
        needed = rarest.groupBy("needle").agg(F.count("*").alias("_needed"))
        cell = ["needle", "segment", "cell"]
        few = sent(rarest)
        blocks = self._blocks(rarest).join(sent(rarest.select("gram").distinct()), "gram", "left_semi")
        full = (
            blocks.select("segment", "cell", "gram").join(few, "gram").groupBy(*cell).agg(F.count("*").alias("_have"))
            .join(needed, "needle").filter("_have = _needed").select(*cell)
        )
        lists = blocks.select("segment", "cell", "gram", "ids").join(full.join(rarest, "needle"), ["segment", "cell", "gram"])
        together = lists.groupBy(*cell).agg(F.collect_list("ids").alias("_lists"))
        shared = F.aggregate(F.slice("_lists", 2, LISTS), F.col("_lists")[0], lambda a, ids: F.array_intersect(a, ids))
        return together.select("needle", F.explode(shared).alias("chunk_id"))

    def first_holding(self, needles: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
        """``(needle, chunk_id, pos)``: the first ``k`` chunks, by number, that hold each distinct needle."""
        found = cut_lineage(self.candidates(needles.distinct()))
        order = [F.asc("chunk_id")]
        short = F.length("needle") <= LONGEST
        sure = found.filter(short)
        long = found.filter(~short)
        texts = chunks.select("chunk_id", F.lower("content").alias("_low"))

        def holding(some: DataFrame) -> DataFrame:
            wanted = cut_lineage(some.select("chunk_id").distinct())
            return some.join(texts.join(sent(wanted), "chunk_id", "left_semi"), "chunk_id").filter(F.contains("_low", F.col("needle"))).select("needle", "chunk_id")

        ahead = cut_lineage(first_rows(long, ["needle"], order, k * AHEAD, "_place"))
        held = cut_lineage(holding(ahead))
        counts = held.groupBy("needle").agg(F.count("*").alias("_held"))
        looked = ahead.groupBy("needle").agg(F.count("*").alias("_looked"))
        # Needles with too few rows so far whose candidates go on.
        open_ = looked.filter(F.col("_looked") == k * AHEAD).join(counts, "needle", "left").filter(F.coalesce("_held", F.lit(0)) < k).select("needle")
        rest = long.join(open_, "needle").join(ahead.select("needle", "chunk_id"), ["needle", "chunk_id"], "left_anti")
        every = sure.select("needle", "chunk_id").unionByName(held).unionByName(holding(rest))
        return first_rows(every, ["needle"], order, k, "pos")
