"""Token ids as files: ids ranked by frequency, in one to four bytes each, with the byte counts apart in control bytes.

A block holds whole documents in a row. Its ids are replaced by their rank in the frequency table of all documents (a block
alone may have its own), so common ids take one byte; four two-bit sizes make a control byte. Decoding looks the sizes up in a table of 256 rows. Blocks are rows of
Parquet files, so that Spark's commit protocol makes them safe against lost executors on any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quaero.llm.arrow import map_batches, slices, small_batches, texts_of
from quaero.llm.common import new_folder, small, stored
from quaero.llm.encoding import encoder, tokenizer_path

END = 2
MAGIC = b"TID1"
# A block is closed when it has so many ids.
BLOCK_IDS = 1 << 20
# Row c has the sizes, in bytes, of the four values of control byte c.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def own_ranks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The rank of each id among ``ids``, and their frequency table."""
    values, which, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(values), dtype=np.uint32)
    rank[order] = np.arange(len(values), dtype=np.uint32)
    return rank[which], values[order].astype("<u4").tobytes()


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """The control bytes and data bytes of ``ranks``."""
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two_bits = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    two_bits[: len(ranks)] = sizes - 1
    control = (two_bits.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    bytes_of = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = bytes_of[np.arange(4) < sizes[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ids(table: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids whose ranks ``encode_ranks`` was given."""
    sizes = SIZES[control].reshape(-1)[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    ranks = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(sizes > k)
        if len(longer):
            ranks[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return table[ranks]


def pack_block(documents: list[np.ndarray], rank: np.ndarray | None = None) -> bytes:
    """The bytes of a block: magic, counts of documents, ids and table entries, the table, the documents' lengths, control
    bytes, data. With ``rank``, the rank of each id in a table kept elsewhere, the block has no table."""
    ids = np.concatenate(documents) if documents else np.zeros(0, dtype="<u4")
    ranks, table = own_ranks(ids) if rank is None else (rank[ids], b"")
    control, data = encode_ranks(ranks)
    lengths = np.array([len(d) for d in documents], dtype="<u4")
    return MAGIC + struct.pack("<III", len(documents), len(ids), len(table) // 4) + table + lengths.tobytes() + control + data


def unpack_block(block: bytes, ranked: np.ndarray | None = None) -> list[np.ndarray]:
    """The ids of each document of a block, whose table is ``ranked`` if it has none of its own."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    documents, n, entries = struct.unpack("<III", block[4:16])
    table = np.frombuffer(block, "<u4", entries, 16)
    lengths = np.frombuffer(block, "<u4", documents, 16 + 4 * entries)
    at, wide = 16 + 4 * (entries + documents), -(-n // 4)
    control = np.frombuffer(block, np.uint8, wide, at)
    ids = decode_ids(table if ranked is None else ranked, control, np.frombuffer(block, np.uint8, offset=at + wide), n)
    return np.split(ids, np.cumsum(lengths)[:-1]) if documents else []


def _packed(ids: np.ndarray) -> bytes:
    """Ids as they are stored between the passes: two bytes each if they fit, else four."""
    return ids.astype("<u2" if not len(ids) or ids.max() <= 0xFFFF else "<u4").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, tie (the text's hash), n, ids of each document, END behind its ids."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        for batch in slices(batches):
            made = [np.append(ids, np.array(END, ids.dtype)) for ids in one.encode(texts_of(batch))]
            columns = [batch.column("doc_id"), batch.column("tie"), pa.array([len(i) for i in made], pa.int32()), pa.array([_packed(i) for i in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "n", "ids"])

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")), encode, f"doc_id {key}, tie bigint, n int, ids binary")


def ranking(rows: DataFrame) -> np.ndarray:
    """The ids of all documents, the most frequent first: counted in the tasks, so that at most a vocabulary comes together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in slices(batches):
            ids = [_unpacked(d, n) for d, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            found = np.bincount(np.concatenate(ids), minlength=len(total)) if ids else total[:0]
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "times"])

    counts = map_batches(rows.select("n", "ids"), count, "id bigint, times bigint").groupBy("id").agg(F.sum("times").alias("times"))
    return counts.orderBy(F.desc("times"), "id").select("id").toPandas()["id"].to_numpy().astype("<u4")


def write_files(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Writes the documents' ids, each with END behind, in ascending doc_id order (null first; equal ones by their text's hash).

    docs: doc_id, text; null text is empty. ``blocks``: part (grows with doc_id), block, n_ids, doc_ids, payload; ``ranks``: the
    ids in the order of their frequency in all documents. Texts are encoded once: what comes out is stored, counted and coded.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    rows = stored(encoded(docs, path or tokenizer_path()), "ids")
    table = ranking(rows)
    rank = np.zeros(int(table.max()) + 1 if len(table) else 1, dtype=np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(kind))), ("payload", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, keys, documents = TaskContext.get().partitionId(), 0, 0, [], []

        def closed():
            columns = [[part], [number], [size], [keys], [pack_block(documents, shared.value)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in slices(batches):
            for doc, n, ids in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")], strict=True):
                keys.append(doc)
                documents.append(_unpacked(ids, n))
                size += n
                if size >= BLOCK_IDS:
                    yield closed()
                    number, size, keys, documents = number + 1, 0, [], []
        if documents:
            yield closed()

    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    key = kind.simpleString()
    made = map_batches(ordered.select("doc_id", "n", "ids"), blocks, f"part int, block int, n_ids bigint, doc_ids array<{key}>, payload binary")
    with small_batches(spark):
        made.write.option("compression", "none").parquet(f"{folder}/blocks")
    ranks = spark.createDataFrame([(table.tobytes(),)], "ids binary")
    ranks.coalesce(1).write.parquet(f"{folder}/ranks")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """part, block, place, doc_id, before (ids before it in its block), n_tokens, ids_crc32 of each document of the files."""
    files = spark.read.parquet(f"{folder}/blocks")
    shared = spark.sparkContext.broadcast(np.frombuffer(spark.read.parquet(f"{folder}/ranks").first()["ids"], "<u4"))
    kind = files.schema["doc_ids"].dataType.elementType
    key, arrow = kind.simpleString(), to_arrow_type(kind)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = unpack_block(row["payload"], shared.value)
                lengths = np.array([len(d) for d in ids], dtype=np.int64)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["block"], np.int32)),
                        pa.array(row["doc_ids"], arrow), pa.array(np.cumsum(lengths) - lengths), pa.array(lengths),
                        pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in ids], pa.int64()),
                    ],
                    ["part", "block", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    return map_batches(files, documents, f"part int, block int, doc_id {key}, before bigint, n_tokens bigint, ids_crc32 bigint")


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, block, base: the ids before each block. Sums run within parts, and once over the parts' totals."""
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block", "n_ids")
    earlier = (W.unboundedPreceding, -1)
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(*earlier))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = F.sum("total").over(W.orderBy("part").rowsBetween(*earlier))
    bases = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_base"))
    return blocks.join(small(bases), "part").select(
        "part", "block", (F.col("part_base") + F.coalesce(within, F.lit(0))).alias("base")
    )


def round_trip(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, as read back from the files written for ``docs``.

    Repeated rows and null numbers keep their rows; an empty text has the end id alone; an empty table writes no block.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    write_files(docs, folder, path)
    found = read_files(spark, folder).join(small(block_starts(spark, folder)), ["part", "block"])
    return found.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
