"""N-gram Jaccard join by a token-group matrix, in exact form.

A document's set is that of its shingles' hashes; documents with one and the same set are a class. Under one order of all
shingles, frequent ones last, two similar sets share a shingle among their first ones (their prefixes). Classes are first
grouped around central ones: each is compared with the most central class of every prefix shingle it shares. The matrix then
holds, for each prefix shingle, the groups that have it; a class is bounded against the groups it meets there, and only groups
that may hold a similar class are opened. Sets are compared in full only where their prefixes leave it open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.arrow import map_batches, slices, texts_of
from quaero.llm.common import small, stored
from quaero.llm.quality import grouped_word_hashes

SHINGLE, PERCENT = 4, 85
# A shingle in more sets or prefixes than this comes last in the order; at most so many are put last, and prefixes are counted
# and made anew at most so often. The order bears on the work alone, not on the result.
FREQUENT, MOST_FREQUENT, ROUNDS = 64, 1_000_000, 3
# Another round is made if the squares of the frequent shingles' counts are more than so many times all shared counts.
BEARABLE = 50
# Bits of the filter that picks the texts to be compared in full: 16 for each, and no more than this (16 MB).
FILTER_BITS = 1 << 27

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
LAST = np.int64(1) << np.int64(62)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """62-bit hashes of all runs of ``width`` words."""
    last = len(words) - width + 1
    run = np.full(last, np.uint64(width))
    for k in range(width):
        run = _scramble(run * np.uint64(_MULTIPLIERS[k % 6]) + words[k : last + k])
    return (run >> np.uint64(2)).astype(np.int64)


def sets_of(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, in ascending order: its runs of ``size`` words, or all its words if it has fewer. A-Z
    count as a-z."""
    for _, words, sizes in grouped_word_hashes([t.lower() for t in texts]):
        runs = _runs(words, size) if len(words) >= size else words[:0].astype(np.int64)
        end = 0
        for n in sizes.tolist():
            start, end = end, end + n
            if n >= size:
                keys = np.sort(runs[start : end - size + 1])
                yield keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
            else:
                yield _runs(words[start:end], n) if n else runs[:0]


def needed(n: int, percent: int) -> int:
    """The fewest members of a set of ``n`` that any similar set shares."""
    return -(-percent * n // 100)


def _print(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if a is None else len(a) for a in arrays]
    mask = np.array([a is None for a in arrays], dtype=bool)
    values = np.concatenate([a for a in arrays if a is not None]) if any(sizes) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32(), mask=np.append(mask, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()))


class _Seen(set):
    """Fingerprints that a task has given out; forgets them before they take much memory."""

    def first(self, item: bytes) -> bool:
        if item in self:
            return False
        if len(self) > 200_000:
            self.clear()
        self.add(item)
        return True


def common_shingles(docs: DataFrame, size: int) -> DataFrame:
    """key, n: the shingles that many sets of some block of texts share. What a fair part of all sets has is among them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, fresh, held = _Seen(), [], 0

        def common():
            keys, times = np.unique(np.concatenate(fresh), return_counts=True)
            often = times >= max(3, len(fresh) // 200)
            return pa.RecordBatch.from_arrays([pa.array(keys[often]), pa.array(times[often], pa.int64())], ["key", "n"])

        for batch in slices(batches):
            for keys in sets_of(texts_of(batch), size):
                if len(keys) and seen.first(_print(keys)):
                    fresh.append(keys)
                    held += len(keys)
                if held > 500_000:
                    yield common()
                    fresh, held = [], 0
        if fresh:
            yield common()

    found = map_batches(docs.select("text"), build, "key bigint, n bigint")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


def _prefix(keys: np.ndarray, late: np.ndarray, percent: int) -> np.ndarray:
    """The first members of a set of which a similar set has one; those of ``late`` (ascending) come last."""
    most = len(keys) - needed(len(keys), percent) + 1
    if not len(late):
        return keys[:most]
    is_late = late[np.minimum(np.searchsorted(late, keys), len(late) - 1)] == keys
    return np.concatenate([keys[~is_late], keys[is_late] | LAST])[:most]


def shingle_table(docs: DataFrame, late: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, digest, n, print, prefix of each document: the md5 of its text, the size of its set, the set's fingerprint, and
    its first members (null where the task has given them before)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in slices(batches):
            prints, counts, prefixes = [], [], []
            for keys in sets_of(texts_of(batch), size):
                mark = _print(keys)
                counts.append(len(keys))
                prints.append(mark)
                prefixes.append(_prefix(keys, shared.value, percent) if len(keys) and seen.first(mark) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(counts, pa.int32()), pa.array(prints, pa.binary()), _lists(prefixes)],
                ["doc_id", "digest", "n", "print", "prefix"],
            )

    return map_batches(docs.select("doc_id", "text", text_digest().alias("digest")), build, f"doc_id {key}, digest string, n int, print binary, prefix array<bigint>"
    )


def reordered_prefixes(docs: DataFrame, before: np.ndarray, late: np.ndarray, size: int, percent: int) -> DataFrame:
    """print, new of the sets whose prefix changes when the shingles of ``late`` come last, no more only those of ``before``."""
    shared = docs.sparkSession.sparkContext.broadcast((before, late))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, orders = _Seen(), shared.value
        for batch in slices(batches):
            prints, prefixes = [], []
            for keys in sets_of(texts_of(batch), size):
                if len(keys):
                    old, new = (_prefix(keys, order, percent) for order in orders)
                    mark = _print(keys)
                    if not np.array_equal(old, new) and seen.first(mark):
                        prints.append(mark)
                        prefixes.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), _lists(prefixes)], ["print", "new"])

    return map_batches(docs.select("text"), build, "print binary, new array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """class_id, keys: the whole sets of the classes of ``wanted`` (class_id, print, doc_id of one of its documents)."""
    hashed = F.xxhash64("doc_id")
    n = wanted.count()
    bits = min(FILTER_BITS, 1 << max(10, (16 * n).bit_length()))
    at = wanted.select(hashed.bitwiseAND(F.lit(bits - 1)).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")
    )
    table = np.zeros(max(1, bits >> 6), dtype=np.int64)
    found = words.toPandas()
    table[found["word"].to_numpy(dtype=np.int64)] = found["mask"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mask = _Seen(), shared.value
        for batch in slices(batches):
            bit = batch.column("bit").to_numpy()
            picked = np.flatnonzero(mask[bit >> 6] >> (bit & 63) & 1)
            prints, sets = [], []
            for keys in sets_of(texts_of(batch.take(pa.array(picked))), size):
                mark = _print(keys)
                if len(keys) and seen.first(mark):
                    prints.append(mark)
                    sets.append(keys)
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), _lists(sets)], ["print", "keys"])

    sets = map_batches(docs.select(hashed.bitwiseAND(F.lit(bits - 1)).alias("bit"), "text"), build, "print binary, keys array<bigint>")
    classes = wanted.select("class_id", "print").distinct()
    return sets.join(classes, "print").select("class_id", "keys").dropDuplicates(["class_id"])


def least_shared(a: Column, b: Column, percent: int) -> Column:
    """The fewest members that similar sets of sizes ``a`` and ``b`` share."""
    return F.ceil((a + b).cast("long") * percent / (100 + percent) - F.lit(1e-9))


def _largest(n: Column, missing: Column | int, percent: int) -> Column:
    """The size of the largest set that may be similar to one of size ``n`` and lacks ``missing`` of its members."""
    return F.floor((n - missing).cast("long") * (100 + percent) / percent - n + F.lit(1e-9))


def _compatible(a: str, b: str, percent: int) -> Column:
    """Whether two classes may be similar by their sizes and what is known to be missing: only a prefix that ends no sooner
    shows what it lacks of the other, beyond the end of a shorter one its set may go on with the same members."""
    fits = lambda x, y: F.col(f"{y}_n") <= F.when(
        F.col(f"{y}_last") >= F.col(f"{x}_last"), F.col(f"{x}_most")
    ).otherwise(_largest(F.col(f"{x}_n"), 0, percent))
    return fits(a, b) & fits(b, a)


def _side(classes: DataFrame, name: str, *columns: str) -> DataFrame:
    return classes.select(*[F.col(c).alias(name if c == "class_id" else f"{name}_{c}") for c in ("class_id", *columns)])


def similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar. Prefixes rule out most of the others: up to the end of the shorter
    one, what only one of the two sets has is known."""
    sides = pairs.join(_side(classes, "a", "n", "prefix"), "a").join(_side(classes, "b", "n", "prefix"), "b")
    end = F.least(F.element_at("a_prefix", -1), F.element_at("b_prefix", -1))
    alone = lambda x, y: F.size(F.filter(F.array_except(f"{x}_prefix", f"{y}_prefix"), lambda k: k <= end))
    least = least_shared(F.col("a_n"), F.col("b_n"), percent)
    open_pairs = stored(
        sides.filter((alone("a", "b") <= F.col("a_n") - least) & (alone("b", "a") <= F.col("b_n") - least)).select("a", "b"), "pairs"
    )
    involved = open_pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    wanted = stored(classes.join(involved, "class_id").select("class_id", "print", "doc_id"), "wanted")
    sets = stored(full_sets(docs, wanted, size), "sets")
    both = open_pairs.join(_side(sets, "a", "keys"), "a").join(_side(sets, "b", "keys"), "b")
    shared = F.size(F.array_intersect("a_keys", "b_keys"))
    union = F.size("a_keys") + F.size("b_keys") - F.col("shared")
    return both.withColumn("shared", shared).filter(100 * F.col("shared") >= percent * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that links reach) of every node of ``links`` (a, b).

    Alternates two steps until nothing changes: every larger neighbour of a node, then every smaller one, is tied to the
    smallest. Each step is a minimum per node and a join, so no node's neighbours meet in one task.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("least", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        tied = large.join(least, "u")
        down = tied.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(tied.select("u", F.col("least").alias("v")))
        edges = stored(down.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _most_frequent(counts: DataFrame, most: int) -> np.ndarray:
    """The keys of ``counts`` (key, n) over FREQUENT, at most ``most`` of them, in ascending order."""
    top = counts.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "key").limit(most).select("key")
    return np.sort(top.toPandas()["key"].to_numpy(dtype=np.int64))


def _classes(docs: DataFrame, table: DataFrame, late: np.ndarray, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """class_id, print, n, doc_id, prefix of each set, frequent shingles last; and key, n of the shingles in several prefixes."""
    distinct = table.filter("prefix is not null").select("print", "n", "doc_id", "prefix").dropDuplicates(["print"])
    classes = stored(distinct.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    for turn in range(ROUNDS + 1):
        counts = classes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        counts = stored(counts.filter("n > 1"), "counts")
        ahead = counts.filter((F.col("n") > FREQUENT) & (F.col("key") < int(LAST)))
        work = ahead.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
        if turn == ROUNDS or work <= BEARABLE * (counts.agg(F.sum("n")).first()[0] or 0):
            break
        more = np.union1d(late, _most_frequent(ahead, MOST_FREQUENT - len(late)))
        changed = reordered_prefixes(docs, late, more, size, percent).dropDuplicates(["print"])
        late = more
        fresh = classes.join(changed, "print", "left").select(
            "class_id", "print", "n", "doc_id", F.coalesce("new", "prefix").alias("prefix")
        )
        classes = stored(fresh, "classes")
    return classes, counts


def links(docs: DataFrame, table: DataFrame, late: np.ndarray, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes, and links (a, b) between them that reach whatever a link reaches."""
    classes, counts = _classes(docs, table, late, size, percent)
    postings = stored(classes.select("class_id", F.explode("prefix").alias("key")).join(counts.select("key"), "key"), "postings")
    # A shingle that no other prefix has is missing in every set whose prefix does not end before this one's: those are at most
    # of size ``most``.
    known = postings.groupBy("class_id").agg(F.count(F.lit(1)).alias("met"))
    missing = F.size("prefix") - F.col("met")
    most = _largest(F.col("n"), F.col("missing"), percent)
    sized = stored(
        classes.join(known, "class_id").withColumn("missing", missing).select(
            "class_id", "n", most.alias("most"), (F.col("missing") / F.col("n")).alias("odd"), F.element_at("prefix", -1).alias("last")
        ), "sized",
    )
    rows = stored(postings.join(sized, "class_id"), "rows")
    best = F.min(F.struct("odd", "class_id", "n", "most", "last")).alias("best")
    centres = rows.groupBy("key").agg(best).select(
        "key", F.col("best.class_id").alias("b"), *[F.col(f"best.{c}").alias(f"b_{c}") for c in ("n", "most", "last")]
    )
    around = rows.select("key", F.col("class_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("n", "most", "last")])
    stars = around.join(centres, "key").filter((F.col("a") != F.col("b")) & _compatible("a", "b", percent))
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = stored(similar(stars, classes, docs, size, percent), "links")
    roots = components(first)

    grouped = sized.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("grp", F.coalesce("root", "class_id")).drop("root")
    groups = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.min("last").alias("end"), F.min("n").alias("g_n"), F.max("most").alias("g_most"))
    grouped = stored(grouped.join(groups.select("grp", "members"), "grp"), "grouped")
    groups = stored(groups, "groups")
    placed = rows.select("key", "class_id").join(grouped, "class_id")
    matrix = placed.groupBy("key", "grp", "members").agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.max("most").alias("max_most"), F.min("last").alias("min_last"), F.max("last").alias("max_last"))
    matrix = matrix.select("key", F.col("grp").alias("g"), F.col("members").alias("g_members"), "min_n", "max_n", "max_most", "min_last", "max_last")
    # As in _compatible, for all members of a group that have the shingle.
    reach = F.when(F.col("min_last") >= F.col("last"), F.col("most")).otherwise(_largest(F.col("n"), 0, percent))
    g_reach = F.when(F.col("last") >= F.col("max_last"), F.col("max_most")).otherwise(_largest(F.col("max_n"), 0, percent))
    met = (
        placed.join(matrix, "key")
        .filter(F.struct("members", "grp") < F.struct("g_members", "g"))
        .filter((F.col("min_n") <= reach) & (F.col("n") <= g_reach))
        .select("class_id", "n", "g", "key").distinct()
        .join(groups.select(F.col("grp").alias("g"), "end", "g_n"), "g")
        .groupBy("class_id", "n", "g", "end", "g_n").agg(F.count_if(F.col("key") <= F.col("end")).alias("met"))
    )
    # What the class has before the end of the group's shortest prefix and the group lacks is missing in all its members.
    absent = F.size(F.filter("prefix", lambda k: k <= F.col("end"))) - F.col("met")
    allowed = F.col("n") - least_shared(F.col("n"), F.col("g_n"), percent)
    opened = met.join(classes.select("class_id", "prefix"), "class_id").filter(absent <= allowed).select("class_id", "g")
    queries = opened.join(_side(sized, "a", "n", "most", "last"), F.col("class_id") == F.col("a")).drop("class_id")
    members = grouped.select(F.col("grp").alias("g"), F.col("class_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("n", "most", "last")])
    pairs = queries.join(members, "g").filter(_compatible("a", "b", percent)).select("a", "b").distinct()
    second = stored(similar(pairs, classes, docs, size, percent), "links")
    return classes, first.unionByName(second)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, digest, stays of each row of ``docs`` (doc_id, text).

    Two rows are linked if 100 x the size of the intersection of their sets is at least ``percent`` x that of the union;
    component_id is the smallest doc_id that links reach. ``digest`` is the md5 of the text, and ``stays`` marks one document
    of each group: the one with the smallest number, then digest. A null or empty text has an empty set and is linked with
    nothing; rows without number take part in links but name no component unless all of it is without; repeated rows are alike
    and give a row each; an empty table gives none. Other columns are not read.
    """
    late = _most_frequent(common_shingles(docs, size), MOST_FREQUENT)
    table = stored(shingle_table(docs, late, size, percent), "shingles")
    classes, found = links(docs, table, late, size, percent)
    roots = components(found)
    me = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "digest")
    members = table.filter("n > 0").groupBy("print").agg(F.min(me).alias("first"))
    rooted = (
        members.join(classes.select("print", "class_id"), "print")
        .join(roots, F.col("class_id") == F.col("node"), "left")
        .select("print", "first", F.coalesce("root", "class_id").alias("root"))
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("keeper"))
    named = rooted.join(smallest, "root").select("print", "keeper")
    return table.join(named, "print", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("keeper.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "digest", F.coalesce(F.col("keeper") == me, F.lit(True)).alias("stays"),
    )


def text_digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without those alike in number and text to a row of ``rows`` (doc_id, digest)."""
    gone = rows.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")) == F.col("gone_digest"))
    return docs.join(small(stored(gone, "gone")), same, "left_anti")


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when one document of each group is kept; of rows alike in
    number and text one stays, and rows without words all stay unless they are such repeats."""
    found = stored(near_duplicates(docs, size, percent), "near")
    kept = without_rows(docs, found.filter(~F.col("stays")))
    twice = found.filter("stays").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = stored(twice.select("doc_id", "digest"), "repeats")
    if twice.isEmpty():
        return kept
    once = without_rows(kept, twice)
    repeated = kept.select(F.struct(*[kept[c] for c in kept.columns]).alias("row"), F.struct("doc_id", text_digest().alias("digest")).alias("same"))
    marks = small(twice.select(F.struct("doc_id", "digest").alias("same")))
    return once.unionByName(repeated.join(marks, "same", "left_semi").dropDuplicates(["same"]).select("row.*"))
