"""Chunks of about 650 tokens with some overlap, and their vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators.keyed import unfold

CHUNK_TOKENS = 650
OVERLAP_TOKENS = 100
# Room for numbering the chunks of a document inside its id.
CHUNKS_PER_DOCUMENT = 1_000_000
SENTENCE_END = r"(?U)(?<=[\.\!\?…])\s+"


def units(c: Column | str, size: int = CHUNK_TOKENS) -> Column:
    """Paragraphs, and the sentences of paragraphs that are too long."""
    text = T.strip(F.regexp_replace(T.text_or_empty(c), "\r\n?", "\n"))
    paragraphs = F.filter(F.transform(F.split(text, "\n{2,}"), T.strip), lambda p: p != "")
    pieces = F.transform(
        paragraphs,
        lambda p: F.when(T.approx_tokens(p) <= size, F.array(p)).otherwise(F.split(p, SENTENCE_END)),
    )
    return F.filter(F.transform(F.flatten(pieces), T.strip), lambda u: u != "")


def bounds(tokens: Column, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """``array<struct(first, past)>``: which units make up each chunk, 0-based.

    Units are packed until the next would pass ``size``. The next chunk starts
    with the trailing units that fit into ``overlap`` tokens, at least with one.
    Only the sizes since the chunk's first unit are carried from unit to unit.
    """
    start = F.struct(
        F.array().cast("array<struct<first:int,past:int>>").alias("done"),
        F.lit(0).alias("first"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("sum"),
        F.array().cast("array<int>").alias("held"),
    )

    def kept(held: Column) -> Column:
        """How many trailing units the next chunk repeats, and their tokens."""
        if overlap <= 0:
            return F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sum"))
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sum"), F.lit(True).alias("open"))

        def step(acc: Column, t: Column) -> Column:
            take = acc["open"] & ((acc["n"] == 0) | (acc["sum"] + t <= overlap))
            return F.struct(
                F.when(take, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
                F.when(take, acc["sum"] + t).otherwise(acc["sum"]).alias("sum"),
                take.alias("open"),
            )

        return F.aggregate(F.reverse(held), begin, step, lambda a: F.struct(a["n"].alias("n"), a["sum"].alias("sum")))

    def step(acc: Column, t: Column) -> Column:
        full = (F.size(acc["held"]) > 0) & (acc["sum"] + t > size)
        tail = kept(acc["held"])
        closed = F.struct(acc["first"].alias("first"), acc["at"].alias("past"))
        return F.when(
            full,
            F.struct(
                F.concat(acc["done"], F.array(closed)).alias("done"),
                (acc["at"] - tail["n"]).alias("first"), (acc["at"] + 1).alias("at"),
                (tail["sum"] + t).alias("sum"),
                F.concat(F.slice(acc["held"], F.size(acc["held"]) - tail["n"] + 1, tail["n"]), F.array(t)).alias("held"),
            ),
        ).otherwise(
            F.struct(
                acc["done"].alias("done"), acc["first"].alias("first"), (acc["at"] + 1).alias("at"),
                (acc["sum"] + t).alias("sum"), F.concat(acc["held"], F.array(t)).alias("held"),
            )
        )

    def finish(acc: Column) -> Column:
        last = F.struct(acc["first"].alias("first"), acc["at"].alias("past"))
        return F.when(F.size(acc["held"]) > 0, F.concat(acc["done"], F.array(last))).otherwise(acc["done"])

    return F.aggregate(tokens, start, step, finish)


def chunk_documents(documents: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS,
                    keep: tuple[str, ...] = ("document_id",), text: str = "content") -> DataFrame:
    """``(*keep, chunk_no, content, token_count)``, chunks in order from 0."""
    split = documents.select(*keep, units(text, size).alias("_units"))
    sized = split.withColumn("_tokens", F.transform("_units", T.approx_tokens))
    cut = sized.withColumn("_bounds", bounds(F.col("_tokens"), size, overlap))
    bodies = F.transform(
        "_bounds",
        lambda b: T.strip(F.array_join(F.slice("_units", b["first"] + 1, b["past"] - b["first"]), "\n\n")),
    )
    rows = unfold(cut, keep, bodies, "chunk_no", "content")
    return rows.withColumn("token_count", T.approx_tokens("content"))


def chunk_pages(documents: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Page by page; ``documents`` has (document_id, pages array<string>), pages count from 1."""
    pages = documents.select("document_id", F.posexplode("pages").alias("_at", "content")).select(
        "document_id", (F.col("_at") + 1).alias("page"), "content"
    )
    return chunk_documents(pages, size, overlap, keep=("document_id", "page"))


def chunk_table(documents: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks as stored: ``(chunk_id, document_id, content, page, section, token_count)``.

    The id is made of document and place, so a repeated run gives the same one.
    """
    chunks = chunk_documents(documents, size, overlap)
    return chunks.select(
        (F.col("document_id") * CHUNKS_PER_DOCUMENT + F.col("chunk_no")).alias("chunk_id"), "document_id", "content",
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"), "token_count",
    )


# --- embedding -------------------------------------------------------------------------

EmbedFn = Callable[[list[str]], np.ndarray]
QUERY_PREFIX = "query: "
# Words whose hash a task keeps, and the longest of them: its memory stays bounded.
WORDS_KEPT, LONGEST_KEPT = 200_000, 64


def hashed_words(dims: int = 64) -> EmbedFn:
    """A model-free embedder: every word adds a sign at a place given by its hash. Words are hashed once while they are kept."""
    kept: dict[str, int] = {}

    def place(word: str) -> int:
        """Twice the word's place, one more if its sign is plus."""
        digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
        at = int.from_bytes(digest[:4], "big") % dims * 2 + (digest[4] & 1)
        if len(word) <= LONGEST_KEPT:
            if len(kept) >= WORDS_KEPT:
                kept.clear()
            kept[word] = at
        return at

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts):
            words = text.lower().split()
            found = [place(w) if at is None else at for w, at in zip(words, map(kept.get, words))]
            times = np.bincount(np.array(found, dtype=np.int64), minlength=2 * dims)
            row += times[1::2] - times[::2]
        return out

    return embed


def embed(rows: DataFrame, text: str, embed_fn: EmbedFn | None = None, batch: int = 48,
          into: str = "embedding", prefix: str = "") -> DataFrame:
    """Adds unit vectors, worked out in batches by a function given by the caller."""
    model = embed_fn or hashed_words()

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = []
            for at in range(0, len(texts), batch):
                block = np.asarray(model([prefix + (t or "") for t in texts.iloc[at:at + batch]]), dtype=np.float64)
                lengths = np.sqrt((block * block).sum(axis=1, keepdims=True))
                made.extend((block / np.where(lengths == 0, 1, lengths)).astype(np.float32))
            yield pd.Series(made, dtype="object")

    return rows.withColumn(into, vectors(F.col(text)))


def embed_queries(queries: DataFrame, embed_fn: EmbedFn | None = None, prefix: str = QUERY_PREFIX) -> DataFrame:
    return embed(queries, "question", embed_fn, prefix=prefix)
