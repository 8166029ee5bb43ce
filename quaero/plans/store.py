"""The stored corpus: documents, chunks and changes as small segments, and the search index that follows them."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.functions import urls as U
from quaero.operators import chunking, cleaning, dense, versioning
from quaero.operators.postings_index import PostingsIndex
from quaero.operators.quantized import QuantizedIndex
from quaero.plans import index
from quaero.session import cut_lineage
from quaero.sources.merge_table import STEP, MergeTable

CHANGE_SCHEMA = f"document_id long, url string, old_hash string, new_hash string, note string, detected_at timestamp, hunks {versioning.HUNKS}"
Embed = Callable[[DataFrame], DataFrame]


def embed_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with vectors by the model-free embedder."""
    return chunking.embed(chunks, "content")


MANUAL_URL, MANUAL_TITLE_CHARS = "manual://admin/", 80


def manual_arrivals(texts: DataFrame) -> DataFrame:
    """Texts that people hand in, prepared like fetched pages: ``(url, title, content, mime_type, seq, content_hash)``.

    ``texts`` has (title, text, url, seq). Without an address one is made from the title, so that a text that is handed in again
    under its title replaces the first one; of several in one batch the last counts.
    """
    title = T.strip(T.text_or_empty("title"))
    given = T.strip(T.text_or_empty("url"))
    made = F.concat(F.lit(MANUAL_URL), F.substring(title, 1, MANUAL_TITLE_CHARS))
    return versioning.prepare(texts.select(
        F.when(given != "", given).otherwise(made).alias("url"), title.alias("title"), F.col("text").alias("content"),
        F.lit("text/plain").alias("mime_type"), "seq",
    ))


class SearchIndex:
    """Stored postings and vectors of chunks; with ``quantized``, compressed vectors in cells, too.

    Chunks are (chunk_id, content, section, embedding); a removed chunk is given as it was added.
    """

    def __init__(self, spark: SparkSession, path: str, quantized: QuantizedIndex | None = None, parts: int = 32):
        self.spark, self.path, self.quantized = spark, path, quantized
        self.words = PostingsIndex(spark, f"{path}/words", parts)
        self._vectors = MergeTable(spark, f"{path}/vectors", "chunk_id long, embedding array<float>", "chunk_id", parts=parts)

    @classmethod
    def open(cls, spark: SparkSession, path: str, quantized: bool = False) -> SearchIndex:
        return cls(spark, path, QuantizedIndex.load(spark, f"{path}/quantized") if quantized else None)

    def quantize(self, cells: int | None = None) -> None:
        """Learn cells and code words from the stored vectors and compress all of them."""
        self.quantized = QuantizedIndex.build(self.vectors(), f"{self.path}/quantized", cells)

    def vectors(self) -> DataFrame:
        """``(chunk_id, embedding)`` of all chunks that have a vector."""
        return self._vectors.current()

    def change(self, added: DataFrame, removed: DataFrame | None = None, segment: int | None = None, cluster: Column | None = None) -> int:
        """Take ``removed`` out, then add ``added``, as one segment: run again, it replaces itself."""
        segment = (max(self._vectors.segments(), default=0) // STEP + 1) * STEP if segment is None else segment
        if removed is not None:
            self.words.remove(removed, segment)
        self.words.add(added, segment + 1, cluster)
        out = None if removed is None else removed.select("chunk_id")
        # Unfolded first: a filter on the vector itself would work it out a second time.
        held = added.select("chunk_id", F.explode_outer(F.array(F.col("embedding").cast("array<float>"))).alias("embedding"))
        known = held.filter(F.size("embedding") > 0)
        self._vectors.apply(known, out, segment)
        if self.quantized:
            if out is not None:
                self.quantized.remove(out, segment)
            self.quantized.add(known, segment)
        return segment

    def dense_topk(self, queries: DataFrame, k: int) -> DataFrame:
        """By the compressed vectors if there are any, else exactly."""
        return self.quantized.topk(queries, k) if self.quantized else dense.dense_topk(queries, self.vectors(), k)


@dataclass
class CorpusStore:
    """Documents, chunks and changes in folder ``path``.

    A run reads the narrow key log and the rows it replaces, and writes what it changes. Its segment has the number that
    the caller gives it (the stream: that of the batch), so a run that is repeated after a failure ends in the same tables.
    """

    spark: SparkSession
    path: str
    index: SearchIndex | None = None
    embed: Embed = embed_chunks

    def __post_init__(self):
        self.documents = MergeTable(self.spark, f"{self.path}/documents", index.DOCUMENT_SCHEMA, "url", ["document_id", "content_hash"])
        self.chunks = MergeTable(self.spark, f"{self.path}/chunks", index.CHUNK_SCHEMA, "document_id")

    def next_segment(self) -> int:
        return (max(self.documents.segments(), default=0) // STEP + 1) * STEP

    def ingest(self, fetched: DataFrame, detected_at: datetime.datetime, segment: int | None = None) -> DataFrame:
        """Fetched pages into the corpus: error pages leave, changed ones are replaced, new ones added."""
        extracted = cut_lineage(index.extract(fetched).drop("links", "assets"))
        errors = fetched.filter("status >= 400").select(U.normalize_url("url").alias("url"))
        dead = errors.unionByName(extracted.filter("soft_404").select("url")).distinct()
        arrivals = versioning.prepare(
            extracted.filter(~F.col("soft_404")).select("url", "title", "content", F.lit("text/html").alias("mime_type"), F.col("page_id").alias("seq"))
        )
        return self.apply(arrivals, dead, detected_at, segment)

    def add_manual(self, texts: DataFrame, detected_at: datetime.datetime, segment: int | None = None) -> DataFrame:
        """Texts that people hand in (title, text, url, seq) as one segment."""
        none = self.spark.createDataFrame([], "url string")
        return self.apply(manual_arrivals(texts), none, detected_at, segment)

    def refresh(self, fetched: DataFrame, detected_at: datetime.datetime, segment: int | None = None) -> DataFrame:
        """Documents whose text still holds menus are extracted again from their pages, as one segment.

        Only good answers count, and only those for the documents chosen; a page that ends elsewhere is stored under that
        address, as any other page.
        """
        segment = self.next_segment() if segment is None else segment
        chosen = cleaning.polluted_documents(self.documents.current(before=segment), limit=None).select(F.col("url").alias("_known"))
        wanted = fetched.filter("status < 400").join(chosen, U.normalize_url("url") == F.col("_known"), "left_semi")
        return self.ingest(wanted, detected_at, segment)

    def apply(self, arrivals: DataFrame, dead: DataFrame, detected_at: datetime.datetime, segment: int | None = None) -> DataFrame:
        """Prepared arrivals (url, title, content, mime_type, content_hash) and dead addresses; returns what became of the
        arrivals: ``(url, status, document_id, old_hash, new_hash)``."""
        segment = self.next_segment() if segment is None else segment
        arrivals = cut_lineage(arrivals)
        known = cut_lineage(self.documents.keys(before=segment).select("url", "document_id", "content_hash"))
        # An address that died in this run is new again if a later page of the run has it.
        gone = known.join(dead.select("url").distinct(), "url", "left_semi")
        alive = known.join(gone.select("url"), "url", "left_anti")
        status = cut_lineage(versioning.upsert_status(alive, arrivals).filter("status != 'kept'"))
        changed = status.filter(F.col("status").isin("new", "updated"))
        first_id = (self.documents.keys(before=segment).agg(F.max("document_id")).first()[0] or 0) + 1
        first_id = max(first_id, (self.chunks._valid("keys", segment).agg(F.max("document_id")).first()[0] or 0) + 1)
        rows = arrivals.drop("document_id").join(changed.select("url", "document_id"), "url")
        touched = cut_lineage(versioning.with_ids(rows.select(*self.documents.columns), first_id))
        updated = changed.filter("status = 'updated'").select("document_id")
        replaced = cut_lineage(updated.unionByName(gone.select("document_id")))
        before = self.chunks.current(before=segment).join(replaced, "document_id", "left_semi")
        fresh = chunking.chunk_table(touched)
        self._log(touched, status, detected_at, segment)
        if self.index is not None:
            new = cut_lineage(self.embed(fresh))
            self.index.change(new, cut_lineage(before), segment)
            fresh = new.select(*self.chunks.columns)
        self.chunks.apply(fresh, replaced, segment)
        # The documents come last: until then, the run is as good as not begun.
        self.documents.apply(touched, gone.select("url"), segment)
        return status.drop("document_id").join(touched.select("url", F.col("document_id").alias("_new")), "url", "left").join(
            known.select("url", "document_id"), "url", "left"
        ).select("url", "status", F.coalesce("_new", "document_id").alias("document_id"), "old_hash", "new_hash")

    def _log(self, touched: DataFrame, status: DataFrame, detected_at: datetime.datetime, segment: int) -> None:
        """One line per updated document, with the lines that went and came."""
        updated = status.filter("status = 'updated'")
        old = self.documents.current(before=segment).join(updated.select("url"), "url", "left_semi").select("url", F.col("content").alias("_old"))
        both = touched.select("url", "content").join(old, "url")
        log = versioning.change_log(updated, F.lit(detected_at).cast("timestamp"))
        lines = log.join(both, "url").withColumn("hunks", versioning.line_hunks(F.col("_old"), F.col("content")))
        # A document may change many times: lines are added, never replaced.
        columns = [c.split()[0] for c in CHANGE_SCHEMA.split(", ")]
        lines.select(*columns).write.mode("overwrite").parquet(f"{self.path}/changes/segment={segment}")

    def change_lines(self) -> DataFrame:
        """All changes of the runs that count, with their segment."""
        rows = self.spark.read.schema(f"{CHANGE_SCHEMA}, segment long").parquet(f"{self.path}/changes")
        return rows.filter(F.col("segment").isin(self.documents.segments()))

    def compact(self) -> None:
        for table in (self.documents, self.chunks):
            table.compact()
