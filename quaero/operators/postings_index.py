"""A stored word index: block-max postings that a batch of queries reads only where they can matter.

Chunks are dealt to cells of about ``CELL`` chunks. A block holds one term's postings in one cell, with the highest count and
the smallest length per count in it, which bound its share of a BM25 score whatever the parameters and the mean length. Each
term's best postings (its champions) are kept as well. A batch of queries

1. gets a floor for each query's k-th score from its terms' champions,
2. adds up the blocks' bounds by query and cell, and
3. opens the blocks of those cells only whose bound reaches the floor.

The index grows by segments. A removal is a segment, too: it marks chunks as gone in all segments before it and takes their
words back out of the counts, so scores are those of the chunks that are left. A segment counts once its line in the manifest
is written, and writing it again replaces it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.functions.text import string_array
from quaero.operators import lexical
from quaero.operators.keyed import first_rows, sent, unfold
from quaero.session import cut_lineage

CELL, CHAMPIONS, CLUSTERS = 256, 32, 256
# Floors and bounds are sums of doubles; what is closer than this is not skipped.
SLACK = 1e-6

PLACE = "struct<pos:int,weight:string>"
SCHEMAS = {
    "blocks": "term string, cell int, n int, max_tf int, least_length double, "
              f"postings array<struct<chunk_id:bigint,tf:int,len:int>>, places array<array<{PLACE}>>, segment long, bucket int",
    "champions": "term string, chunk_id long, tf int, len int, segment long, bucket int",
    "terms": "term string, df long, segment long, bucket int",
    "gone": "chunk_id long, segment long",
    "segments": "n_chunks long, n_words long, segment long",
}


def _share(tf: Column, length: Column, average: float, k1: float, b: float) -> Column:
    """What a term that occurs ``tf`` times in a chunk of ``length`` words adds to its score, for an idf of one."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(average)))


def _split(chunks: DataFrame, *keep: str) -> DataFrame:
    """``(chunk_id, *keep, _n, len, _words)``: ``_n`` section words first, then content, whose words ``len`` counts."""
    section = lexical.words_of("section") if "section" in chunks.columns else string_array([])
    return chunks.select("chunk_id", *keep, section.alias("_section"), lexical.words_of("content").alias("_content")).select(
        "chunk_id", *keep, F.size("_section").alias("_n"), F.size("_content").alias("len"), F.concat("_section", "_content").alias("_words")
    )


def _words(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, len, term, pos, weight)``."""
    rows = unfold(_split(chunks), ["chunk_id", "_n", "len"], "_words", "_at", "term")
    weight = F.when(F.col("_at") < F.col("_n"), "A").otherwise("B")
    return rows.select("chunk_id", "len", "term", (F.col("_at") + 1).cast("int").alias("pos"), weight.alias("weight"))


# A block on its way to its folder: numbers in flat lists, a place of weight A below zero.
PACKED = "term string, cell int, n int, max_tf int, least_length double, _ids array<bigint>, _tfs array<int>, _lens array<int>, _spots array<array<int>>"


def _first_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where one of the keys differs from the row before."""
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _cell_blocks(cell: pa.Table) -> pa.Table:
    """The blocks of one cell, from the split texts of its chunks."""
    words = pa.concat_arrays(cell.column("_words").chunks)
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    chunk, length, sections = (cell.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("chunk_id", "len", "_n"))
    # Rows alike in number and length are one chunk.
    known, row = np.unique(np.stack([chunk, length]), axis=1, return_inverse=True)
    coded = words.flatten().dictionary_encode()
    term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    plain = (at >= np.repeat(sections, sizes)).astype(np.int64)
    owner = np.repeat(row.ravel(), sizes)
    order = np.lexsort((plain, at, owner, term))
    term, owner, at, plain = term[order], owner[order], at[order], plain[order]
    posting = _first_of(term, owner)
    tf = np.add.reduceat(plain, posting) if len(posting) else plain
    owner, ends = owner[posting], np.append(posting, len(term))
    block = _first_of(term[posting])
    shorter = np.where(tf > 0, known[1][owner] / np.maximum(tf, 1), np.inf)
    reduced = lambda of, values: of.reduceat(values, block) if len(block) else values
    least = reduced(np.minimum, shorter)
    stops = pa.array(np.append(block, len(posting)), pa.int32())
    listed = lambda values, kind: pa.ListArray.from_arrays(stops, pa.array(values, kind))
    spots = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.where(plain, at + 1, -at - 1), pa.int32()))
    return pa.table({
        "term": coded.dictionary.take(pa.array(term[posting][block])),
        "cell": pa.array(np.full(len(block), cell.column("cell")[0].as_py()), pa.int32()),
        "n": pa.array(reduced(np.add, (tf > 0).astype(np.int64)), pa.int32()),
        "max_tf": pa.array(reduced(np.maximum, tf), pa.int32()),
        "least_length": pa.array(least, pa.float64(), mask=np.isinf(least)),
        "_ids": listed(known[0][owner], pa.int64()), "_tfs": listed(tf, pa.int32()), "_lens": listed(known[1][owner], pa.int32()),
        "_spots": pa.ListArray.from_arrays(stops, spots),
    })


def _unpacked(blocks: DataFrame) -> DataFrame:
    posting = F.arrays_zip(F.col("_ids").alias("chunk_id"), F.col("_tfs").alias("tf"), F.col("_lens").alias("len"))
    place = lambda s: F.struct(F.abs(s).alias("pos"), F.when(s < 0, "A").otherwise("B").alias("weight"))
    places = F.transform("_spots", lambda spots: F.transform(spots, place))
    return blocks.select("term", "cell", "n", "max_tf", "least_length", posting.alias("postings"), places.alias("places"), "bucket")


@dataclass
class PostingsIndex:
    """The index in folder ``path``."""

    spark: SparkSession
    path: str
    # Folders that terms are dealt to; a search reads those of its terms. The same for all segments.
    buckets: int = 32

    # --- writing ---------------------------------------------------------------------------

    def _next(self) -> int:
        return (self._read("segments").agg(F.max("segment")).first()[0] or 0) + 1

    def _write(self, df: DataFrame, name: str, segment: int, by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}/segment={segment}")

    def add(self, chunks: DataFrame, segment: int | None = None, cluster: Column | None = None) -> int:
        """A segment of ``chunks`` (chunk_id, content and, if there is one, section). One pass over the texts.

        Chunks alike in ``cluster`` (a language, a site) share cells, which sharpens the bounds; the result does not depend
        on it.
        """
        segment = self._next() if segment is None else segment
        group = F.lit(0) if cluster is None else F.pmod(F.xxhash64(cluster), F.lit(CLUSTERS)).cast("int")
        chunks = chunks.withColumn("_group", group)
        # A count for each of at most CLUSTERS groups; the cells of a group follow those of the ones before it.
        counts = {r["_group"]: r["count"] for r in chunks.groupBy("_group").count().collect()}
        n_chunks, numbers, first = sum(counts.values()), [], 0
        for g, n in sorted(counts.items()):
            numbers += [F.lit(g), F.struct(F.lit(first).alias("first"), F.lit(-(-n // CELL)).alias("cells"))]
            first += -(-n // CELL)
        own = F.element_at(F.create_map(*numbers), F.col("_group")) if numbers else F.struct(F.lit(0).alias("first"), F.lit(1).alias("cells"))
        cell = (own["first"] + F.pmod(F.xxhash64("chunk_id"), own["cells"])).cast("int").alias("cell")
        # Texts go to the task of their cell, which lays out its blocks in place: a shuffled row is a text or a block, never a word.
        dealt = chunks.withColumn("cell", cell).repartition("cell")
        laid_out = _split(dealt, "cell").groupBy("cell").applyInArrow(_cell_blocks, PACKED).withColumn("bucket", self._bucket())
        ordered = laid_out.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "cell")
        self._write(_unpacked(ordered), "blocks", segment, "bucket")

        written = self.spark.read.schema(_without("blocks", "segment")).parquet(f"{self.path}/blocks/segment={segment}")
        self._write(written.groupBy("term", "bucket").agg(F.sum("n").alias("df")).filter("df > 0").repartition("bucket"), "terms", segment, "bucket")
        n_words = written.agg(F.sum(F.aggregate(F.col("postings.tf"), F.lit(0).cast("long"), lambda a, tf: a + tf))).first()[0] or 0
        postings = written.filter("n > 0").select("term", "bucket", F.explode("postings").alias("_p")).select("term", "bucket", "_p.*").filter("tf > 0")
        share = _share(F.col("tf"), F.col("len"), max(1.0, n_words / max(1, n_chunks)), 1.2, 0.75)
        best = first_rows(postings, ["term"], [F.desc(share), F.asc("chunk_id")], CHAMPIONS)
        self._write(best.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "champions", segment, "bucket")
        self._commit(segment, n_chunks, n_words)
        return segment

    def remove(self, chunks: DataFrame, segment: int | None = None) -> int:
        """A segment that takes ``chunks``, given as they were added, out of all segments before it."""
        segment = self._next() if segment is None else segment
        known = cut_lineage(chunks.select("chunk_id", F.size(lexical.words_of("content")).alias("len")))
        once = _words(chunks).filter("weight = 'B'").groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))
        lost = once.groupBy("term").agg((-F.count("*")).alias("df")).withColumn("bucket", self._bucket())
        self._write(lost.repartition("bucket"), "terms", segment, "bucket")
        self._write(known.select("chunk_id"), "gone", segment)
        total = known.agg(F.count("*").alias("n"), F.sum("len").alias("words")).first()
        self._commit(segment, -total["n"], -(total["words"] or 0))
        return segment

    def _commit(self, segment: int, n_chunks: int, n_words: int) -> None:
        line = self.spark.createDataFrame([(n_chunks, n_words)], "n_chunks long, n_words long")
        self._write(line.coalesce(1), "segments", segment)

    # --- reading ---------------------------------------------------------------------------

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # only a part that is not there yet is empty
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _manifest(self) -> tuple[list[int], int, int]:
        """The segments that count, and their chunks and words: one row per segment."""
        rows = self._read("segments").collect()
        return [r["segment"] for r in rows], sum(r["n_chunks"] for r in rows), sum(r["n_words"] for r in rows)

    def _of(self, name: str, segments: list[int], buckets: list[int] | None = None) -> DataFrame:
        rows = self._read(name).filter(F.col("segment").isin(segments))
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _buckets(self, terms: DataFrame) -> list[int]:
        """The folders that hold the terms: ``buckets`` at most."""
        return [r[0] for r in terms.select(self._bucket()).distinct().collect()]

    def _alive(self, postings: DataFrame, segments: list[int]) -> DataFrame:
        """``postings`` (chunk_id, segment, ...) without what a later segment takes out."""
        gone = self._of("gone", segments).select(F.col("chunk_id").alias("_gone"), F.col("segment").alias("_by"))
        if gone.isEmpty():
            return postings
        taken = gone.groupBy("_gone").agg(F.max("_by").alias("_by"))
        return postings.join(taken, (F.col("chunk_id") == F.col("_gone")) & (F.col("segment") < F.col("_by")), "left_anti")

    def weights(self, queries: DataFrame, segments: list[int], n_chunks: int) -> DataFrame:
        """``(query_id, term, idf)`` of the words of the queries that the index has."""
        asked = cut_lineage(queries.select("query_id", F.explode(F.array_distinct(lexical.words_of("question"))).alias("term")))
        counts = self._of("terms", segments, self._buckets(asked)).join(sent(asked.select("term").distinct()), "term", "left_semi")
        frequency = counts.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        idf = F.log(1 + (F.lit(n_chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return cut_lineage(asked.join(frequency, "term").select("query_id", "term", idf.alias("idf")))

    def floors(self, weighted: DataFrame, segments: list[int], average: float, k: int, k1: float, b: float) -> DataFrame:
        """``(query_id, floor)``: no score of a query's best ``k`` chunks is lower, as ``k`` of its terms' champions reach it."""
        champions = self._alive(self._of("champions", segments, self._buckets(weighted)), segments).join(sent(weighted), "term")
        partial = champions.groupBy("query_id", "chunk_id").agg(
            F.sum(F.col("idf") * _share(F.col("tf"), F.col("len"), average, k1, b)).alias("score")
        )
        return cut_lineage(
            first_rows(partial, ["query_id"], [F.desc("score")], k).groupBy("query_id")
            .agg(F.count("*").alias("_n"), F.min("score").alias("floor")).filter(F.col("_n") == k).select("query_id", "floor")
        )

    def open_cells(self, weighted: DataFrame, segments: list[int], average: float, k: int, k1: float, b: float,
                   floors: DataFrame | None = None) -> DataFrame:
        """``(query_id, segment, cell, bound, open)``: the cells that have a word of the query, and whether they may hold one
        of its best ``k`` chunks."""
        floors = self.floors(weighted, segments, average, k, k1, b) if floors is None else floors
        heads = self._of("blocks", segments, self._buckets(weighted)).filter("n > 0").select("segment", "cell", "term", "max_tf", "least_length")
        most = _share(F.col("max_tf"), F.col("least_length") * F.col("max_tf"), average, k1, b)
        bounds = heads.join(sent(weighted), "term").groupBy("query_id", "segment", "cell").agg(F.sum(F.col("idf") * most).alias("bound"))
        reach = F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - SLACK
        return bounds.join(sent(floors), "query_id", "left").select("query_id", "segment", "cell", "bound", reach.alias("open"))

    def bm25_topk(self, queries: DataFrame, k: int = 18, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """``(query_id, chunk_id, score, rank)`` by BM25 over any of a query's distinct words, as ``lexical.bm25_topk``.

        Only blocks of words that some query has leave the scan. They meet by cell, where scores are added up in place, and only
        chunks that reach their query's floor are ordered.
        """
        segments, n_chunks, n_words = self._manifest()
        average = n_words / n_chunks if n_chunks and n_words else 1.0
        weighted = self.weights(queries, segments, n_chunks)
        floors = self.floors(weighted, segments, average, k, k1, b)
        opened = self.open_cells(weighted, segments, average, k, k1, b, floors).filter("open")
        openers = opened.groupBy("segment", "cell").agg(F.collect_list("query_id").alias("_open"))
        least = self.spark.sparkContext.defaultParallelism
        tasks = lexical.tasks_for(max(0, n_chunks), weighted.select("query_id").distinct().count(), least)
        blocks = self._of("blocks", segments, self._buckets(weighted)).filter("n > 0").select("segment", "cell", "term", "postings")
        needed = blocks.join(sent(weighted.select("term").distinct()), "term", "left_semi").repartition(tasks, "segment", "cell")
        met = needed.join(openers, ["segment", "cell"]).join(sent(weighted), "term").filter(F.array_contains("_open", F.col("query_id")))
        postings = met.select("segment", "cell", "query_id", "idf", F.explode("postings").alias("_p")).filter("_p.tf > 0")
        scored = postings.groupBy("segment", "cell", "query_id", "_p.chunk_id").agg(
            F.sum(F.col("idf") * _share(F.col("_p.tf"), F.col("_p.len"), average, k1, b)).alias("score")
        )
        high = scored.join(sent(floors), "query_id", "left").filter(F.col("score") >= F.coalesce("floor", F.lit(0.0)) - SLACK)
        alive = self._alive(high.select("query_id", "segment", "chunk_id", "score"), segments).drop("segment")
        return first_rows(alive, ["query_id"], [F.desc(F.round("score", 9)), F.asc("chunk_id")], k, "rank")

    def matches(self, terms: DataFrame) -> DataFrame:
        """``(query_id, alt, chunk_id, occurrences)`` as ``lexical.lexical_matches``.

        Cells that lack a required word are skipped; in the others the words' lists are intersected, and word positions are
        read for what is left.
        """
        segments, _, _ = self._manifest()
        terms = cut_lineage(lexical.distinct_operands(terms))
        required = cut_lineage(terms.filter(~F.col("negate")).select("query_id", "alt", "term").distinct())
        needed = required.groupBy("query_id", "alt").agg(F.count("*").alias("_needed"))
        asked = sent(cut_lineage(terms.select("term").distinct()))
        blocks = self._of("blocks", segments, self._buckets(terms)).join(asked, "term", "left_semi")
        cell = ["query_id", "alt", "segment", "cell"]
        full = (
            blocks.select("segment", "cell", "term").join(sent(required), "term").groupBy(*cell).agg(F.count("*").alias("_have"))
            .join(needed, ["query_id", "alt"]).filter("_have = _needed").select(*cell)
        )
        lists = blocks.select("segment", "cell", "term", F.col("postings.chunk_id").alias("_ids")).join(
            full.join(required, ["query_id", "alt"]), ["segment", "cell", "term"]
        )
        shared = F.aggregate(F.slice("_lists", 2, 1 << 30), F.col("_lists")[0], lambda a, ids: F.array_intersect(a, ids))
        together = lists.groupBy(*cell).agg(F.collect_list("_ids").alias("_lists"))
        found = self._alive(together.select(*cell, F.explode(shared).alias("chunk_id")), segments)
        words = cut_lineage(found).join(terms, ["query_id", "alt"])
        # A block is met once, whatever asks for it, and gives out the places of the chunks that are left.
        wanted = words.groupBy("segment", "cell", "term").agg(F.collect_set("chunk_id").alias("_wanted"))
        read = blocks.join(wanted, ["segment", "cell", "term"]).select(
            "segment", "term", "_wanted", F.arrays_zip(F.col("postings.chunk_id").alias("id"), F.col("places").alias("at")).alias("_all")
        )
        kept = F.filter("_all", lambda p: F.array_contains("_wanted", p["id"]))
        places = read.select("segment", "term", F.inline(kept).alias("chunk_id", "positions"))
        placed = places.join(words, ["segment", "term", "chunk_id"])
        return lexical.occurrences(placed, terms)

    def lexical_topk(self, queries: DataFrame, k: int | None = 18, plain: bool = False) -> DataFrame:
        """``(query_id, chunk_id, score, rank)`` by cover density, as ``lexical.lexical_topk``."""
        return lexical.best_covers(self.matches(lexical.query_terms(queries, plain)), k)


def _without(name: str, column: str) -> str:
    return ", ".join(c for c in SCHEMAS[name].split(", ") if not c.startswith(f"{column} "))
