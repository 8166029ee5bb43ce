"""Hard negatives by rotated one-bit codes, with intervals that hold for certain.

Every vector of whole numbers is rotated (random signs and Hadamard transforms) and stored with the signs of what comes out, its
alignment with that code vector (the inner product with the signs scaled to length one) and the length of the rest. For an
anchor, quantised to a few bit planes, popcounts give its inner product with a code; by Cauchy-Schwarz the rest of the vector,
which is orthogonal to the code, adds no more than its length times that of the anchor's own part off the code. Rows whose
interval cannot reach what an anchor still asks for are left out, all others are scored in whole numbers.

Anchors are a stated set of queries: they are met in blocks of a proven size, each in one pass over the stored codes in which a
task keeps only the first few rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.llm.common import new_folder, stored

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
# A negative scores from LOW to HIGH percent of the positive.
LOW, HIGH = 50, 95
SEED, TURNS, PLANES = 20_240, 3, 6
# Components of all anchors of a block: 8 MB, and as much again for their rotations.
BLOCK_VALUES = 1 << 20
# Rows and anchors that meet at a time in a task.
_ROWS, _ANCHORS = 2048, 128
_MOST = (1 << 63) - 1


def rotated(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` (a row each) under one and the same random rotation, in the next power of two of dimensions."""
    n, width = vectors.shape
    wide = 1 << max(0, (width - 1).bit_length()) if width else 1
    out = np.zeros((n, wide))
    out[:, :width] = vectors
    for turn in range(TURNS):
        out *= np.random.default_rng([SEED, turn, wide]).choice([-1.0, 1.0], wide)
        step = 1
        while step < wide:
            pairs = out.reshape(n, -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, wide)
            step *= 2
        out /= np.sqrt(wide)
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    octets = np.packbits(bits, axis=1, bitorder="little")
    missing = -octets.shape[1] % 8
    return np.pad(octets, ((0, 0), (0, missing))).view("<u8")


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one-bit codes of ``vectors``, their alignment with the code vector and the length of what it leaves."""
    turned = rotated(vectors)
    along = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    rest = np.sqrt(np.maximum(0, (turned**2).sum(axis=1) - along**2))
    return _packed(turned >= 0), along, rest


def _popcounts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bits of every row of ``a`` with every row of ``b``."""
    total = np.zeros((len(a), len(b)))
    for word in range(a.shape[1]):
        total += np.bitwise_count(a[:, word, None] & b[None, :, word])
    return total


@dataclass
class Planes:
    """Anchors of one width: quantised to bit planes, with the length of what quantising leaves out."""

    planes: list[np.ndarray]
    lowest: np.ndarray
    step: np.ndarray
    total: np.ndarray
    error: np.ndarray
    norm: np.ndarray
    width: int

    @classmethod
    def of(cls, vectors: np.ndarray) -> Planes:
        turned = rotated(vectors)
        lowest = turned.min(axis=1)
        span = turned.max(axis=1) - lowest
        step = np.where(span > 0, span / ((1 << PLANES) - 1), 1.0)
        level = np.rint((turned - lowest[:, None]) / step[:, None]).astype(np.int64)
        near = lowest[:, None] + step[:, None] * level
        planes = [_packed((level >> p & 1).astype(bool)) for p in range(PLANES)]
        error = np.sqrt(((turned - near) ** 2).sum(axis=1))
        return cls(planes, lowest, step, near.sum(axis=1), error, np.sqrt((turned**2).sum(axis=1)), turned.shape[1])

    def part(self, at: slice) -> Planes:
        columns = (self.lowest, self.step, self.total, self.error, self.norm)
        return Planes([p[at] for p in self.planes], *[c[at] for c in columns], self.width)

    def intervals(self, code: np.ndarray, along: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the inner products of these anchors with vectors of the given codes."""
        ones = np.bitwise_count(code).sum(axis=1)
        chosen = self.lowest[:, None] * ones
        for p, plane in enumerate(self.planes):
            chosen += self.step[:, None] * (1 << p) * _popcounts(plane, code)
        guess = (2 * chosen - self.total[:, None]) / np.sqrt(self.width)
        error, norm = self.error[:, None], self.norm[:, None]
        # The anchor's part along the code is at least so long; the rest of the vector meets only the part off the code.
        off = np.sqrt(np.maximum(0, norm**2 - np.maximum(0, np.abs(guess) - error) ** 2))
        # Far above the rounding errors of 64-bit numbers.
        slack = error * along + off * rest + 1e-9 * norm * (along + rest)
        middle = guess * along
        return middle - slack, middle + slack


def _matrix(column: pa.Array, exact: type) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The vectors of a list column by width: the rows of each width and their components."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
    out = {}
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        out[width] = rows, values[starts[rows, None] + np.arange(width)].astype(exact)
    return out


def coded(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label, v (whole numbers), code, along, rest of the rows that take part."""
    finite = F.forall("embedding", lambda x: F.abs(x.cast("double")) < float("inf"))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    taken = rows.select("vec_id", "label", "embedding").filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = rows.schema["label"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, _ROWS):
                batch = whole_batch.slice(at, _ROWS)
                code, along, rest = [b""] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for places, vectors in _matrix(batch.column("v"), np.float64).values():
                    words, along[places], rest[places] = codes(vectors)
                    for i, word in zip(places.tolist(), words):
                        code[i] = word.tobytes()
                columns = [*batch.columns, pa.array(code, pa.binary()), pa.array(along), pa.array(rest)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "label", "v", "code", "along", "rest"])

    numbered = taken.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("v"))
    return numbered.mapInArrow(build, f"row bigint, vec_id bigint, label {label}, v array<bigint>, code binary, along double, rest double")


class Best:
    """The first ``k`` rows of each item: highest scores, then smallest numbers (null last), first."""

    def __init__(self, items: int, k: int, exact: type):
        self.k = k
        self.least = np.full(items, -np.inf).astype(exact)
        self.kept = [np.zeros(0, t) for t in (np.int64, exact, np.int64, np.int64)]

    def add(self, item: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        if not len(item):
            return
        item, score, vec, row = (np.concatenate(x) for x in zip(self.kept, (item, score, vec, row)))
        order = np.lexsort((row, vec, -score, item))
        item, score, vec, row = (x[order] for x in (item, score, vec, row))
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        self.least[item[rank == self.k - 1]] = score[rank == self.k - 1]
        self.kept = [x[rank < self.k] for x in (item, score, vec, row)]


@dataclass
class Block:
    """Anchors that are sent to all tasks: what they ask for, by width."""

    row: np.ndarray
    label: list
    widths: dict
    planes: dict
    low: np.ndarray  # of each anchor and slot: the least and the greatest score asked for
    high: np.ndarray
    same: bool  # rows of the anchor's label, or of others
    k: int
    exact: type

    def search(self, table: DataFrame) -> DataFrame:
        """item, score, vec_id, row: for each anchor and slot at least the first k rows of ``table`` that it asks for."""
        shared = table.sparkSession.sparkContext.broadcast(self)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: Block = shared.value
            best = Best(block.low.size, block.k, block.exact)
            for whole in batches:
                for at in range(0, whole.num_rows, _ROWS):
                    block.meet(whole.slice(at, _ROWS), best)
            item, score, vec, row = best.kept
            columns = [pa.array(item), pa.array([int(s) for s in score], pa.int64()), pa.array(vec, mask=vec == _MOST), pa.array(row)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "score", "vec_id", "row"])

        # No more tasks than run at once: each gives out k rows for an anchor.
        tasks = table.coalesce(table.sparkSession.sparkContext.defaultParallelism)
        return tasks.mapInArrow(build, "item bigint, score bigint, vec_id bigint, row bigint")

    def meet(self, batch: pa.RecordBatch, best: Best) -> None:
        numbers = {x: i for i, x in enumerate(dict.fromkeys(self.label))}
        labels = np.array([numbers.get(x, -1) for x in batch.column("label").to_pylist()], dtype=np.int64)
        own = np.array([numbers[x] for x in self.label], dtype=np.int64)
        vec = batch.column("vec_id").fill_null(_MOST).to_numpy()
        row = batch.column("row").to_numpy()
        along, rest = batch.column("along").to_numpy(), batch.column("rest").to_numpy()
        code = batch.column("code").to_pylist()
        for width, (places, vectors) in _matrix(batch.column("v"), self.exact).items():
            if width not in self.widths:
                continue
            words = np.frombuffer(b"".join([code[i] for i in places]), "<u8").reshape(len(places), -1)
            anchors, whole = self.widths[width]
            for at in range(0, len(anchors), _ANCHORS):
                part = slice(at, at + _ANCHORS)
                who = anchors[part]
                slots = self.low.shape[1]
                least = np.maximum(self.low[who], best.least.reshape(self.low.shape)[who])
                lower, upper = self.planes[width].part(part).intervals(words, along[places], rest[places])
                live = (own[who, None] == labels[places]) == self.same
                live &= (row[places] != self.row[who, None]) & (upper >= least.min(axis=1)[:, None]) & (lower <= self.high[who].max(axis=1)[:, None])
                columns = np.flatnonzero(live.any(axis=0))
                if not len(columns):
                    continue
                live = live[:, columns]
                scores = np.clip(np.dot(whole[part], vectors[columns].T), -_MOST, _MOST) if self.exact is object else whole[part] @ vectors[columns].T
                for slot in range(slots):
                    a, r = np.nonzero(live & (scores >= least[:, slot, None]) & (scores <= self.high[who, slot, None]))
                    at_row = places[columns[r]]
                    best.add(who[a] * slots + slot, scores[a, r], vec[at_row], row[at_row])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each item, with their rank from 1."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _in_blocks(anchors: DataFrame, size: int) -> tuple[str, int]:
    """The folder of ``anchors`` in parts (block=0, 1, ...) of at most ``size`` rows, and their number."""
    placed = stored(anchors.withColumn("at", F.monotonically_increasing_id()), "anchors")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    ends = np.cumsum([0] + [c["count"] for c in counts]).tolist()
    before = placed.sparkSession.createDataFrame([(c["part"], e) for c, e in zip(counts, ends)] or [(0, 0)], "part bigint, before bigint")
    joined = placed.withColumn("part", part).join(F.broadcast(before), "part")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    folder = new_folder(anchors.sparkSession, "blocks")
    joined.withColumn("block", F.floor(place / size)).drop("part", "before", "at").write.partitionBy("block").parquet(folder)
    return folder, -(-ends[-1] // size)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows (vec_id, label, embedding) for which
    ``is_anchor`` holds.

    Each component x becomes floor(scale * x), and scores are inner products of these whole numbers; higher ones come first,
    then smaller vec_id, null last. An anchor's positives are its first other rows of the same label; for each of them come the
    first rows of another label that score from ``low`` to ``high`` percent of it. Rows with a null label or vector or with a
    component that is null or not finite take no part; vectors of different widths are not compared, empty ones score 0. Rows
    without number may be found but are last among equals. Repeated rows count as rows of their own, also as anchors. Scores
    beyond 64 bits are held at their ends. An empty table, or one without anchors, gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    table = stored(coded(rows, scale), "codes")
    chosen = table.filter(is_anchor).select("row", "vec_id", "label", "v")
    extent = lambda v: F.greatest(F.abs(F.array_max(v).cast("double")), F.abs(F.array_min(v).cast("double")))
    size = table.agg(F.max(F.size("v")).alias("width"), F.max(extent("v")).alias("extent")).first()
    exact = object if (size["width"] or 0) * (size["extent"] or 0) ** 2 >= 2.0**53 else np.float64
    folder, blocks = _in_blocks(chosen, max(1, block_values // max(1, size["width"] or 0)))
    out = new_folder(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    for b in range(blocks):
        anchors = spark.read.schema(chosen.schema).parquet(f"{folder}/block={b}").toArrow().combine_chunks()
        n, vectors = len(anchors), anchors["v"].combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        widths = _matrix(vectors, exact)
        planes = {w: Planes.of(v.astype(np.float64)) for w, (_, v) in widths.items()}
        ask = lambda low, high, same, k: Block(anchors["row"].to_numpy(), anchors["label"].to_pylist(), widths, planes, low, high, same, k, exact)  # noqa: E731, B023
        every = np.full((n, 1), np.inf).astype(exact)
        near = _first(ask(-every, every, True, positives).search(table), positives)
        near = near.select("item", "rank", F.col("vec_id").alias("id"), "score").toArrow()
        # At most ``positives`` rows for each anchor of the block; slots that have none ask for nothing.
        least, most = np.full((n, positives), np.inf).astype(exact), np.full((n, positives), -np.inf).astype(exact)
        ids, scores = np.zeros(n * positives, dtype=object), np.zeros(n * positives, dtype=np.int64)
        for item, rank, found, score in zip(*[near[c].to_pylist() for c in ("item", "rank", "id", "score")]):
            least[item, rank - 1], most[item, rank - 1] = -(-low * score // 100), high * score // 100
            ids[item * positives + rank - 1], scores[item * positives + rank - 1] = found, score
        hard = _first(ask(least, most, False, negatives).search(table), negatives)
        _with_pairs(hard, anchors["vec_id"].to_pylist(), ids, scores, positives, schema).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out) if blocks else spark.createDataFrame([], schema)


def _with_pairs(hard: DataFrame, anchor_ids: list, ids: np.ndarray, scores: np.ndarray, positives: int, schema: str) -> DataFrame:
    """The ranked rows with the numbers and the score of the pair that asked for them."""
    shared = hard.sparkSession.sparkContext.broadcast((anchor_ids, ids, scores))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, ids, scores = shared.value
        for batch in batches:
            items = batch.column("item").to_numpy()
            columns = [
                pa.array([anchor_ids[i // positives] for i in items], pa.int64()), pa.array([ids[i] for i in items], pa.int64()),
                batch.column("rank"), batch.column("vec_id"), pa.array(scores[items]), batch.column("score"),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return hard.mapInArrow(build, schema)


def with_shifted_labels(rows: DataFrame) -> DataFrame:
    """The rows, where every seventh number's label is the next of ten."""
    shifted = F.when(F.col("vec_id") % 7 == 0, ((F.col("label").cast("long") + 1) % 10)).otherwise(F.col("label").cast("long"))
    return rows.select("vec_id", shifted.alias("label"), "embedding")
