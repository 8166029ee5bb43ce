"""Near duplicates by SimHash, through an inverted index of the fingerprints' byte positions with count filtering.

Fingerprints of 64 bits that differ in at most three have at least five of their eight positional bytes in common. The lists of
single bytes hold a 256th of all fingerprints each, so they are met three at a time: of any five positions, three lie in the
first or in the second half, and so eight lists of three bytes hold every pair. Within a list the positional bytes that a pair
shares are tallied, pairs with five or more are kept, and their bits are compared. A list longer than LONGEST gives way to lists
of five bytes, and such a one to lists of five of the eight blocks of three bits that are left: those hold 512 fingerprints at
most, so no list is unbounded, and no pair is lost on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.arrow import slices, texts_of
from quaero.llm.common import stored
from quaero.llm.jaccard import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
POSITIONS = 8
SHARED = POSITIONS - DISTANCE
LONGEST = 2048
# Shingles of a text that are hashed at a time.
_AT_ONCE = 1 << 16

THREE = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
FIVE = list(combinations(range(POSITIONS), SHARED))


def _bit_counts(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """How many hashes of shingles have each bit, lowest first, and the number of shingles."""
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(size, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _AT_ONCE):
        hashes = [hashed(text[i:j], SEED) for i, j in zip(starts[at : at + _AT_ONCE], stops[at : at + _AT_ONCE])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return counts, len(starts)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The bits set in over half of the hashes of a text's shingles, as a signed number; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    counts, n = _bit_counts(words, size)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint of each row of ``docs`` (doc_id, text)."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = [fingerprint(t, size) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(build, f"doc_id {key}, fingerprint bigint")


def _parts(places: tuple[int, ...], width: int) -> Column:
    """The blocks of ``width`` bits of a fingerprint at ``places``, side by side."""
    block = lambda p: F.shiftrightunsigned("fingerprint", width * p).bitwiseAND(F.lit((1 << width) - 1))
    joined = F.lit(0).cast("long")
    for p in places:
        joined = F.shiftleft(joined, width).bitwiseOR(block(p))
    return joined


def _lists(groups: list[tuple[int, ...]]) -> Column:
    """A list's key for each group of byte positions: the group's number above the bytes."""
    bits = 8 * len(groups[0])
    return F.array(*[_parts(g, 8).bitwiseOR(F.lit(k << bits)) for k, g in enumerate(groups)])


def three_byte_postings(marks: DataFrame) -> DataFrame:
    return marks.select("fingerprint", F.explode(_lists(THREE)).alias("key"), F.lit(0).alias("rest"))


def five_byte_postings(members: DataFrame) -> DataFrame:
    """The postings of lists of three bytes that are too long in all lists of five bytes with those three."""
    wider = [F.array(*[F.lit(k) for k, g in enumerate(FIVE) if set(t) <= set(g)]) for t in THREE]
    group = F.element_at(F.array(*wider), (F.shiftright("key", 24) + 1).cast("int"))
    chosen = members.select("fingerprint", F.explode(group).alias("k"), _lists(FIVE).alias("lists"))
    return chosen.select("fingerprint", F.element_at("lists", F.col("k") + 1).alias("key"), F.lit(0).alias("rest")).distinct()


def last_postings(members: DataFrame) -> DataFrame:
    """The postings of lists of five bytes that are too long, by five of the eight blocks of the 24 bits that are left."""
    left = [[p for p in range(POSITIONS) if p not in g] for g in FIVE]
    others = F.element_at(F.array(*[_parts(tuple(p), 8) for p in left]), (F.shiftright("key", 40) + 1).cast("int"))
    block = lambda p: F.shiftright("others", 3 * p).bitwiseAND(F.lit(7))
    keys = []
    for k, g in enumerate(FIVE):
        joined = F.lit(k).cast("long")
        for p in g:
            joined = F.shiftleft(joined, 3).bitwiseOR(block(p))
        keys.append(joined.cast("int"))
    return members.select("fingerprint", "key", others.alias("others")).select("fingerprint", "key", F.explode(F.array(*keys)).alias("rest"))


def _roots(up: np.ndarray) -> np.ndarray:
    while not np.array_equal(up, up[up]):
        up = up[up]
    return up


def tied(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each fingerprint the place of the first one that links within its list reach; ``ends`` says where its list ends."""
    up, here = np.arange(len(marks)), np.arange(len(marks))
    for step in range(1, len(marks)):
        here = here[here + step < ends[here]]
        if not len(here):
            break
        unlike = marks[here] ^ marks[here + step]
        shared = (unlike.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        counted = np.flatnonzero(shared >= SHARED)
        near = counted[np.bitwise_count(unlike[counted]) <= DISTANCE]
        a, b = here[near], here[near] + step
        while len(a):
            up = _roots(up)
            a, b = up[a], up[b]
            apart = a != b
            a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(up, b, a)
    return _roots(up)


def _links_within(postings: DataFrame) -> DataFrame:
    """Links (a, b) that tie together what is linked within the lists, at most one for each posting."""

    def find(table: pa.Table) -> pa.RecordBatch:
        keys, rests = table["key"].to_numpy(), table["rest"].to_numpy()
        marks = table["fingerprint"].to_numpy().view(np.uint64)
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (rests[1:] != rests[:-1])])
        sizes = np.diff(np.append(np.flatnonzero(new), len(keys)))
        up = tied(marks, np.repeat(np.append(np.flatnonzero(new)[1:], len(keys)), sizes))
        moved = np.flatnonzero(up != np.arange(len(up)))
        return pa.RecordBatch.from_arrays([pa.array(marks[x].view(np.int64)) for x in (moved, up[moved])], ["a", "b"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            keys, rests = table["key"].to_numpy(), table["rest"].to_numpy()
            # The last list may go on in the next batch.
            other = np.flatnonzero((keys != keys[-1]) | (rests != rests[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            held = table.slice(cut)
            if cut:
                yield find(table.slice(0, cut))
        if held is not None:
            yield find(held)

    dealt = postings.repartition("key", "rest").sortWithinPartitions("key", "rest", "fingerprint")
    return dealt.mapInArrow(build, "a bigint, b bigint")


def links(marks: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``marks`` (fingerprint) that reach whatever links of at most DISTANCE
    bits reach."""
    found, postings = None, three_byte_postings(marks)
    for narrower in (five_byte_postings, last_postings, None):
        sizes = postings.groupBy("key", "rest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = postings.join(sizes, ["key", "rest"])
        if narrower is None:
            return found.unionByName(_links_within(shared.select("key", "rest", "fingerprint")))
        shared = stored(shared, "postings")
        short = _links_within(shared.filter(F.col("n") <= longest).select("key", "rest", "fingerprint"))
        found = short if found is None else found.unionByName(short)
        long_lists = shared.filter(F.col("n") > longest)
        if long_lists.isEmpty():
            return found
        postings = narrower(long_lists)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, longest: int = LONGEST) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row of ``docs`` (doc_id, text).

    Fingerprints come from the XXH64 (seed 42) of the text's runs of ``size`` words, A-Z as a-z, repeats included; of all its
    words if it has fewer. Two rows are linked if their fingerprints differ in at most DISTANCE bits; component_id is the
    smallest doc_id that links reach. Null, empty and blank texts have fingerprint zero and are linked like any other. Rows
    without number take part in links but name no component unless all of it is without; repeated rows give a row each; an
    empty table gives none. Other columns are not read.
    """
    table = stored(fingerprints(docs, size), "fingerprints")
    marks = stored(table.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "marks")
    roots = components(stored(links(marks, longest), "links"))
    rooted = marks.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fingerprint", "component_id")
    return table.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
