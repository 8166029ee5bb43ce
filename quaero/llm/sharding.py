"""Shards by extendible hashing: a directory indexed by hash prefixes in which only oversized buckets take another bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import small, stored

SHARD_BYTES = 64 * 1024 * 1024
# The limit of the registered query: small enough that the buckets of small tables are split, too.
QUERY_BYTES = 256 * 1024
# The hash has 128 bits. Sums are kept for cells of so many bits more than the directory is expected to need.
HASH_BITS, FINER = 128, 6


def hash_bits(key: Column) -> Column:
    """The md5 of a key as a text of 128 characters 0 and 1."""
    digest = F.md5(key.cast("binary"))
    words = [F.conv(F.substring(digest, at, 8), 16, 2) for at in (1, 9, 17, 25)]
    return F.concat(*[F.lpad(w, 32, "0") for w in words])


def rows_with_bits(docs: DataFrame) -> DataFrame:
    """doc_id, copy, n_bytes, bits of each row. Rows alike in number and text are told apart by ``copy``, from 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    alike = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text.cast("binary")).alias("digest"))
    copies = alike.groupBy("doc_id", "n_bytes", "digest").agg(F.count(F.lit(1)).alias("n"))
    each = copies.select("doc_id", "n_bytes", "digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("copy").cast("string"))
    return each.select("doc_id", "copy", "n_bytes", hash_bits(key).alias("bits"))


def _prefix(name: str, depth: int) -> Column:
    return F.substring(name, 1, depth) if depth else F.lit("")


def _sums(rows: DataFrame, prefix: Column) -> DataFrame:
    return rows.groupBy(prefix.alias("shard")).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n"))


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, list[int]]:
    """shard (hash prefix), depth, shard_bytes, shard_rows of every bucket, and the depths that occur.

    Starts from one bucket; a bucket over ``limit`` bytes with more than one row is split on the next bit, the others stay.
    Rows are added up once, into cells a few bits finer than the expected directory; only rows of cells that are still too
    large are added up again.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(0, int(total // max(1, limit)).bit_length()) + FINER)
    pending = rows.select("bits", "n_bytes", F.lit(1).cast("long").alias("n"))
    cells = stored(_sums(pending, _prefix("bits", bits)), "cells")
    found, depths, over = [], [], None
    for depth in range(HASH_BITS + 1):
        if depth > bits:
            bits = min(HASH_BITS, bits + FINER)
            still = rows.select("bits", "n_bytes", F.lit(1).cast("long").alias("n")).join(
                small(over.select(F.col("shard").alias("taken"))), _prefix("bits", depth - 1) == F.col("taken"), "left_semi"
            )
            cells = stored(_sums(still, _prefix("bits", bits)), "cells")
        part = cells
        if over is not None:
            part = cells.join(small(over.select(F.col("shard").alias("taken"))), _prefix("shard", depth - 1) == F.col("taken"), "left_semi")
        level = stored(_sums(part, _prefix("shard", depth)), "level")
        whole = (F.col("n_bytes") <= limit) | (F.col("n") == 1)
        counts = level.agg(F.count_if(whole).alias("done"), F.count_if(~whole).alias("over")).first()
        if counts.done or not depth:
            depths.append(depth)
            found.append(
                level.filter(whole | F.lit(depth == HASH_BITS)).select(
                    "shard", F.lit(depth).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.col("n").alias("shard_rows")
                )
            )
        if not counts.over:
            break
        over = level.filter(~whole)
    shards = found[0]
    for more in found[1:]:
        shards = shards.unionByName(more)
    return shards, depths


def shard(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, copy, n_bytes, shard, depth, shard_bytes, shard_rows: one row per row of ``docs`` (doc_id, text).

    ``limit`` counts UTF-8 bytes of text; a row larger than it has a shard of its own. Null texts have 0 bytes; null numbers
    and repeated rows are spread like others, as the hash takes number, text and ``copy``. Extra columns are not read. An
    empty table has no shards.
    """
    rows = stored(rows_with_bits(docs), "rows")
    shards, depths = directory(rows, limit)
    keys = F.explode(F.array(*[_prefix("bits", d) for d in depths])).alias("shard")
    return rows.select("doc_id", "copy", "n_bytes", keys).join(small(shards), "shard").select(
        "doc_id", "copy", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"
    )
