"""From fetched pages to the searchable, versioned corpus."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.functions import urls as U
from quaero.operators import chunking, cleaning, html, versioning
from quaero.session import cut_lineage


@dataclass
class IndexUpdate:
    """What one run of the indexing job changes."""

    documents: DataFrame
    chunks: DataFrame
    changes: DataFrame
    status: DataFrame
    dead: DataFrame
    touched: DataFrame
    fresh_chunks: DataFrame


DOCUMENT_SCHEMA = (
    "document_id long, url string, title string, content string, content_hash string, mime_type string"
)
CHUNK_SCHEMA = (
    "chunk_id long, document_id long, content string, page int, section string, token_count int"
)


def extract(fetched: DataFrame) -> DataFrame:
    """Usable HTML pages with their text: ``(page_id, url, title, content, soft_404, links, assets)``.

    ``fetched`` has (page_id, final_url, status, content_type, html).
    """
    kind = cleaning.content_kind(F.col("content_type"), F.col("final_url"), F.col("html"))
    pages = fetched.filter((F.col("status") < 400) & (kind == "html")).select(
        "page_id", U.normalize_url("final_url").alias("url"), "html"
    )
    texts = html.extract_pages(pages)
    return texts.withColumn("soft_404", cleaning.is_soft_404(F.lit(200), F.col("title"), F.col("content")))


def update(fetched: DataFrame, documents: DataFrame, chunks: DataFrame,
           detected_at: datetime.datetime, first_id: int | None = None) -> IndexUpdate:
    """One pass: dead pages leave, changed ones are replaced, new ones added.

    New documents are numbered from ``first_id``, by default after the highest known.
    """
    if first_id is None:
        first_id = (documents.agg(F.max("document_id")).first()[0] or 0) + 1
    # Pages are parsed once; everything below reads what came out.
    extracted = cut_lineage(extract(fetched).drop("links", "assets"))
    errors = fetched.filter("status >= 400").select(U.normalize_url("url").alias("url"))
    dead = errors.unionByName(extracted.filter("soft_404").select("url")).distinct()
    alive, kept_chunks = versioning.delete(documents, dead, chunks)
    arrivals = cut_lineage(versioning.prepare(
        extracted.filter(~F.col("soft_404")).select(
            "url", "title", "content", F.lit("text/html").alias("mime_type"), F.col("page_id").alias("seq")
        )
    ))
    status = cut_lineage(versioning.upsert_status(alive, arrivals))
    after = versioning.with_ids(versioning.upsert(alive, arrivals), first_id)
    touched = cut_lineage(after.join(
        status.filter(F.col("status").isin("new", "updated")).select("url"), "url", "left_semi"
    ).select(*after.columns))
    fresh = chunking.chunk_table(touched)
    return IndexUpdate(
        documents=after,
        chunks=versioning.replace_chunks(kept_chunks, status, fresh),
        changes=versioning.change_log(status, F.lit(detected_at)),
        status=status,
        dead=dead,
        touched=touched,
        fresh_chunks=fresh,
    )
