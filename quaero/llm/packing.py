"""Best-fit packing by minimum bin slack.

Only the number of pieces of each length matters for which lengths share a sequence, so the plan is made from at most
``capacity`` counts: the longest length left opens a sequence, a bitset subset sum over the lengths left finds the fullest
combination beside it, and that combination is taken as often as the counts allow. The pieces themselves are numbered within
their length and looked up in the plan by the tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaero.llm.arrow import map_batches, slices, texts_of
from quaero.llm.common import small, stored
from quaero.llm.encoding import encoder, tokenizer_path

CAPACITY = 2048
END = 0
# Pieces of one length are numbered in lots of so many on average.
LOT = 20_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` as far as possible, taking no more than there are; long ones first."""
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many, before = min(counts[length], room // length), 1, bits
        while left:
            take = min(many, left)
            bits |= (bits << (length * take)) & mask
            left -= take
            many *= 2
        steps.append((length, before))
        if bits >> room & 1:
            break
    target, taken = bits.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> (target - n * length) & 1:
            n += 1
        if n:
            taken[length] = n
            target -= n * length
    return taken


@dataclass
class Plan:
    """Rows by (length, first): from the piece ``first`` of its length on, ``per`` pieces go to each sequence from ``base``
    on, side by side from ``offset``."""

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The minimum-bin-slack plan for ``counts`` pieces by length."""
    left, used, rows, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        rest = {x: n - (x == longest) for x, n in left.items() if n > (x == longest)}
        mix = fullest(rest, capacity - longest)
        mix[longest] = mix.get(longest, 0) + 1
        times, offset = min(left[x] // n for x, n in mix.items()), 0
        for length in sorted(mix, reverse=True):
            rows.append((length, used[length], mix[length], sequences, offset))
            offset += length * mix[length]
            used[length] += times * mix[length]
            left[length] -= times * mix[length]
            if not left[length]:
                del left[length]
        sequences += times
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def pieces(docs: DataFrame, capacity: int, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with END behind, cut only where longer than ``capacity``."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        for batch in slices(batches):
            owner, starts, lengths, sums = [], [], [], []
            for row, ids in enumerate(one.encode(texts_of(batch))):
                whole = np.append(ids, np.array(END, ids.dtype)).astype("<u4").tobytes()
                for at in range(0, len(whole), 4 * capacity):
                    part = whole[at : at + 4 * capacity]
                    owner.append(row)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            start = np.array(starts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array((start // capacity).astype(np.int32)),
                    pa.array(start), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_batches(docs.select("doc_id", "text"), cut, f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def numbered_within_length(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``cut`` with ``k``, the number of a piece among those of its length, from 0. No length meets in one task: pieces are
    numbered within lots of about LOT by a hash, and the lots' sizes are added up. ``counts``: the pieces of each length."""
    many = [F.lit(x) for length, n in counts.items() if n > LOT for x in (length, -(-n // LOT))]
    lots = F.coalesce(F.try_element_at(F.create_map(*many), "length"), F.lit(1)) if many else F.lit(1)
    spread = cut.withColumn("lot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), lots))
    sizes = spread.groupBy("length", "lot").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("lot").rowsBetween(W.unboundedPreceding, -1))
    bases = sizes.select("length", "lot", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("length", "lot").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return spread.withColumn("within", within).join(small(bases), ["length", "lot"]).withColumn("k", F.col("base") + F.col("within"))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of ``docs`` (doc_id, text).

    A null text is empty and takes the end id alone. Repeated rows and null numbers are packed each for itself; equal lengths
    are interchangeable, and ordered by hash, number and piece. An empty table has no sequences; extra columns are not read.
    """
    cut = stored(pieces(docs, capacity, path or tokenizer_path()), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(counts, capacity))
    key = docs.schema["doc_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        order = p.length << 44 | p.first
        for batch in slices(batches):
            length, k = batch.column("length").to_numpy(), batch.column("k").to_numpy()
            row = np.searchsorted(order, length << 44 | k, side="right") - 1
            turn, slot = np.divmod(k - p.first[row], p.per[row])
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(p.base[row] + turn), pa.array(p.offset[row] + slot * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return map_batches(numbered_within_length(cut, counts).select("doc_id", "piece", "start", "length", "ids_crc32", "k"), assign, f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
