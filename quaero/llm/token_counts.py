"""Token counts by a two-tier lookup: a broadcast table of frequent words, and the worker's cache for the others.

Texts are never taken apart into rows: each task counts its own words and hands on only its most frequent ones, from which
the broadcast table is made. The table only saves work; a word that it lacks is encoded.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.arrow import map_batches, slices, texts_of
from quaero.llm.encoding import CACHED, LONGEST, WordEncoder, encoder, parted, tokenizer_path

LIMIT = 2048
# Words in the broadcast table (some 6 MB), and those that a task hands on.
TABLE, PER_TASK = 65_536, 4_096


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in slices(batches):
        for group in parted(texts_of(batch)):
            times = np.bincount(group.which, minlength=len(group.words)).tolist()
            counts.update(dict(zip(group.words, times, strict=True)))
            if len(counts) > CACHED // 2:  # the rarest make room
                counts = Counter(dict(counts.most_common(CACHED // 8)))
    tops = [(w, n) for w, n in counts.most_common(PER_TASK) if len(w) <= LONGEST]
    yield pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in tops], pa.binary()), pa.array([n for _, n in tops], pa.int64())], ["word", "n"]
    )


def frequent_words(docs: DataFrame, size: int = TABLE) -> list[bytes]:
    """At most ``size`` words that are frequent in some task's share of the documents, most frequent first."""
    tops = map_batches(docs.select("text"), _tops, "word binary, n bigint")
    rows = tops.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).select("word").collect()
    return [bytes(r.word) for r in rows]


def length_table(path: str, words: list[bytes]) -> dict[bytes, int]:
    """The number of ids of each word."""
    one = encoder(path)
    return {w: len(ids) // one.width for w, ids in zip(words, one.learn(words, False), strict=True)}


class LengthCounter:
    """Numbers of ids: the shared table first, then the worker's own cache."""

    def __init__(self, path: str, table: dict[bytes, int]):
        self.encoder = encoder(path)
        self.table = table

    def look_up(self, words: list[bytes], latin: bool) -> np.ndarray:
        table, cache = self.table, lengths(self.encoder)
        misses = [w for w in words if w not in table and w not in cache]
        fresh = {w: len(ids) // self.encoder.width for w, ids in zip(misses, self.encoder.learn(misses, latin), strict=True)}
        found = [table[w] if w in table else cache[w] if w in cache else fresh[w] for w in words]
        if len(cache) + len(fresh) > CACHED:
            cache.clear()
        cache.update((w, n) for w, n in fresh.items() if len(w) <= LONGEST)
        return np.array(found, dtype=np.int64)

    def counts(self, texts: list[bytes]) -> list[int]:
        done, begun = [], 0
        for group in parted(texts):
            sums = np.concatenate([[0], np.cumsum(self.look_up(group.words, group.latin is not None)[group.which])])
            each = np.diff(sums[group.ends], prepend=0).tolist()
            each[0] += begun
            begun = each[0] if group.open else 0
            if not group.open:
                done += each
        return done


@functools.cache
def lengths(of: WordEncoder) -> dict[bytes, int]:
    """The worker's cache of lengths, kept from task to task."""
    return {}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text).

    Counts are those of the tokenizer without added special tokens. A null text counts as empty: no bytes, no tokens. Repeated
    rows and null numbers keep their rows; other columns are not read; an empty table gives no rows.
    """
    path = path or tokenizer_path()
    table = docs.sparkSession.sparkContext.broadcast(length_table(path, frequent_words(docs)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = LengthCounter(path, table.value)
        for batch in slices(batches):
            texts = texts_of(batch)
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            tokens = np.array(counter.counts(texts), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), count, f"doc_id {key}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
