"""Change detection, upserts, deletes and duplicate groups by content hash.

Documents have (document_id, url, title, content, content_hash, ...); the url
is unique among stored documents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaero.functions import text as T
from quaero.operators.cleaning import scrub
from quaero.values import replies

MIN_CHARS = 40
TITLE_CHARS = 512


def prepare(fetched: DataFrame) -> DataFrame:
    """Scrubbed, hashed arrivals; short ones are dropped, of equal addresses the last counts.

    ``fetched`` has (url, title, content, seq).
    """
    rest = [c for c in fetched.columns if c != "url"]
    # Unfolded first: a filter on the text itself would clean it a second time.
    once = F.explode_outer(F.array(scrub(T.strip(T.text_or_empty("content")))))
    cleaned = fetched.select(*[c for c in fetched.columns if c != "content"], once.alias("content")).filter(
        F.length("content") >= MIN_CHARS
    )
    latest = cleaned.groupBy("url").agg(F.max_by(F.struct(*rest), "seq").alias("_row"))
    return latest.select("url", "_row.*").withColumn("content_hash", T.content_hash("content")).withColumn(
        "title", F.substring("title", 1, TITLE_CHARS)
    )


def upsert_status(current: DataFrame, arrivals: DataFrame) -> DataFrame:
    """``(url, status, document_id, old_hash, new_hash)``: new, updated, unchanged or kept."""
    old = current.select("url", "document_id", F.col("content_hash").alias("old_hash"))
    new = arrivals.select("url", F.col("content_hash").alias("new_hash"))
    status = (
        F.when(F.col("new_hash").isNull(), "kept").when(F.col("old_hash").isNull(), "new")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    )
    return old.join(new, "url", "full_outer").select("url", status.alias("status"), "document_id", "old_hash", "new_hash")


def change_log(status: DataFrame, detected_at: Column) -> DataFrame:
    """One row per updated document: ``(document_id, url, old_hash, new_hash, note, detected_at)``."""
    return status.filter("status = 'updated'").select(
        "document_id", "url", "old_hash", "new_hash",
        F.format_string(replies.CHANGE_NOTE, "url").alias("note"), detected_at.alias("detected_at"),
    )


def line_changes(old: Column, new: Column) -> Column:
    """``struct(removed, added)``: distinct lines only one of the two texts has."""
    a, b = (F.array_distinct(F.filter(T.lines(c), lambda s: s != "")) for c in (old, new))
    return F.struct(F.array_except(a, b).alias("removed"), F.array_except(b, a).alias("added"))


def _anchors(old: list[str], new: list[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """Pairs of equal lines between a to b of ``old`` and c to d of ``new``, in the order of both.

    Lines that stand once on either side; failing those, lines that stand as often on both, the n-th with the n-th. Of these
    the longest chain that keeps the order, by patience sorting.
    """
    places: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for i in range(a, b):
        places[old[i]][0].append(i)
    for j in range(c, d):
        places[new[j]][1].append(j)
    both = [p for p in places.values() if len(p[0]) == len(p[1])]
    pairs = [(i[0], j[0]) for i, j in both if len(i) == 1] or sorted(x for p in both for x in zip(*p))
    tops, ends, before = [], [], {}
    for i, j in pairs:
        at = bisect_left(tops, j)
        before[i] = ends[at - 1] if at else None
        tops[at : at + 1], ends[at : at + 1] = [j], [(i, j)]
    chain, link = [], ends[-1] if ends else None
    while link:
        chain.append(link)
        link = before[link[0]]
    return chain[::-1]


def _blocks(old: list[str], new: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """What differs: stretches a to b of ``old`` and c to d of ``new``, in order."""
    open_ = [(0, len(old), 0, len(new))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and old[a] == new[c]:
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
        chain = _anchors(old, new, a, b, c, d) if a < b and c < d else []
        if chain:
            starts = [(a, c), *[(i + 1, j + 1) for i, j in chain]]
            stops = [*chain, (b, d)]
            open_ += [(a, b, c, d) for (a, c), (b, d) in zip(reversed(starts), reversed(stops))]
        elif a < b or c < d:
            yield a, b, c, d


HUNKS = "array<struct<old_line:int,removed:array<string>,new_line:int,added:array<string>>>"


def hunks_of(old: str, new: str) -> list[tuple[int, list[str], int, list[str]]]:
    """The changes from ``old`` to ``new`` in order: where in the old text, which lines go, where in the new one, which come."""
    a, b = old.split("\n"), new.split("\n")
    return [(i + 1, a[i:j], k + 1, b[k:m]) for i, j, k, m in _blocks(a, b)]


def line_hunks(old: Column, new: Column) -> Column:
    """The ordered line diff of two texts, null as empty: lines that stand once in both texts anchor it, what lies between two
    anchors is solved alike."""

    @F.pandas_udf(HUNKS)
    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([hunks_of(a or "", b or "") for a, b in zip(old, new)], dtype="object")

    return diff(old, new)


def apply_hunks(text: Column, hunks: Column) -> Column:
    """The new text from the old one and its hunks."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def step(acc: Column, hunk: Column) -> Column:
        kept = F.slice(acc["rest"], F.lit(1), hunk["old_line"] - acc["next"])
        after = hunk["old_line"] + F.size(hunk["removed"])
        return F.struct(
            F.concat(acc["done"], kept, hunk["added"]).alias("done"),
            F.slice(acc["rest"], after - acc["next"] + 1, F.greatest(F.size(acc["rest"]), F.lit(1))).alias("rest"),
            after.alias("next"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), lines.alias("rest"), F.lit(1).alias("next"))
    return F.aggregate(hunks, start, step, lambda acc: F.array_join(F.concat(acc["done"], acc["rest"]), "\n"))


def upsert(current: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The documents after the arrivals: updated in place, new ones added with a null id.

    Numbers and hashes alone decide what changes; a stored text is only kept or left out.
    """
    known = current.select("url", "document_id", F.col("content_hash").alias("_old"))
    changed = arrivals.drop("document_id").join(known, "url", "left").filter(
        F.col("_old").isNull() | (F.col("_old") != F.col("content_hash"))
    )
    kept = current.join(changed.select("url"), "url", "left_anti")
    return kept.select(*current.columns).unionByName(changed.select(*[c for c in current.columns if c in changed.columns]), allowMissingColumns=True)


ID_BUCKETS = 4096


def with_ids(documents: DataFrame, first_id: int, id_column: str = "document_id") -> DataFrame:
    """New documents are numbered from ``first_id``, by bucket and address.

    Each bucket numbers its own rows; what comes before it is added from one
    count per bucket. The same arrivals always get the same numbers.
    """
    order = [F.col("url")]
    bucket = F.pmod(F.xxhash64("url"), F.lit(ID_BUCKETS))
    new = documents.filter(F.col(id_column).isNull()).withColumn("_bucket", bucket)
    sizes = new.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = new.withColumn("_local", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    numbered = local.join(offsets, F.col("_bucket") == F.col("_b")).withColumn(
        id_column, F.lit(first_id) + F.col("_offset") + F.col("_local") - 1
    )
    return documents.filter(F.col(id_column).isNotNull()).unionByName(numbered.select(*documents.columns))


def dead_urls(fetched: DataFrame, soft_404: Column) -> DataFrame:
    """``(url)`` of pages that answered with an error or say that they do not exist."""
    return fetched.filter((F.col("status") >= 400) | soft_404).select("url").distinct()


def delete(documents: DataFrame, dead: DataFrame, *dependants: DataFrame) -> tuple[DataFrame, ...]:
    """Documents without the dead addresses, and each dependent table without their rows."""
    gone = documents.join(dead.select("url").distinct(), "url", "left_semi").select("document_id")
    alive = documents.join(dead.select("url").distinct(), "url", "left_anti").select(*documents.columns)
    return alive, *[d.join(gone, "document_id", "left_anti").select(*d.columns) for d in dependants]


def replace_chunks(chunks: DataFrame, status: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Chunks of updated documents give way to the new ones; all others stay untouched."""
    changed = status.filter("status = 'updated'").select("document_id")
    kept = chunks.join(changed, "document_id", "left_anti").select(*chunks.columns)
    return kept.unionByName(new_chunks, allowMissingColumns=True)


def duplicate_groups(documents: DataFrame) -> DataFrame:
    """``(content_hash, n, keeper)`` of texts that occur more than once; the lowest id is kept."""
    return documents.groupBy("content_hash").agg(
        F.count("*").alias("n"), F.min("document_id").alias("keeper")
    ).filter("n > 1")


def keep_first_copies(documents: DataFrame) -> DataFrame:
    """One document per content hash, the one with the lowest id.

    Copies are dropped map-side, so a text with countless copies costs one row per task.
    """
    rest = [c for c in documents.columns if c != "content_hash"]
    first = documents.groupBy("content_hash").agg(F.min_by(F.struct(*rest), "document_id").alias("_row"))
    return first.select("_row.*", "content_hash").select(*documents.columns)
