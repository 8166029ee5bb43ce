"""Ranked, ordered and substring operators that hold when one key owns much of the data.

Nothing here collects a group. Per-key order is worked out in buckets of a
bounded width whose results are then carried across buckets, so a key with a
third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaero.functions.text import string_array
from quaero.session import cut_lineage

BUCKET_WIDTH = 10_000
MAX_SEEDS = 2_000
# Narrow rows (numbers, words) that are sent to every task: counted before.
SENT = 200_000


def sent(df: DataFrame) -> DataFrame:
    """Stored narrow rows, marked for broadcast where they are few: after a checkpoint Spark no longer knows how many there are, and
    would shuffle the large table that they pick rows from."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every key.

    The rank filter lets each task drop all but ``n`` rows per key before the shuffle.
    """
    name = rank or "_rank"
    ranked = df.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def unfold(df: DataFrame, keep: Sequence[str], array: Column | str, at: str, value: str) -> DataFrame:
    """One row per element of an array that is costly to work out, with its 0-based place.

    The outer form is used because Spark tests the argument of the inner one
    for emptiness first, which works it out again.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, value))
    return rows.filter(F.col(at).isNotNull())


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    into: str,
    include_current: bool = False,
    width: int = BUCKET_WIDTH,
    tie: Sequence[Column] = (),
    bucket_of: Column | None = None,
) -> DataFrame:
    """Into each row, the last value before it in its key that is not null.

    ``order`` is a numeric column. Rows are cut into buckets of ``width`` along
    it, or by ``bucket_of``, which never falls along it; each bucket is solved
    alone and then receives what the earlier ones carry, of which there is one
    row per bucket.
    """
    keys = list(keys)
    bucket = [*keys, "_bucket"]
    own = F.floor(F.col(order) / F.lit(width)) if bucket_of is None else bucket_of
    rows = df.withColumn("_bucket", own).withColumn("_value", value)
    ordering = [F.col(order), *tie]
    inside = (
        Window.partitionBy(*bucket).orderBy(*ordering)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    position = F.struct(F.col(order), *tie)
    ends = (
        rows.groupBy(*bucket)
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), position)).alias("_end"))
    )
    before = (
        Window.partitionBy(*keys).orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(*bucket, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    solved = rows.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    return (
        solved.join(carried, same_key(solved, carried, bucket), "left")
        .select(*[solved[c] for c in df.columns], F.coalesce("_inside", "_carried").alias(into))
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    into: str,
) -> DataFrame:
    """Into each left row, the whole latest right row of its key at or before it.

    Both sides are laid along one time line, so no pair of rows is ever
    produced. The line of all keys is cut into runs of about equal size, however
    many rows a key or an hour has; what a run ends with is carried into the
    next ones. Times are timestamps.
    """
    payload = F.struct(*[F.col(c) for c in right.columns])
    shape = left.schema
    events = right.select(
        *keys,
        F.unix_micros(F.col(right_time)).alias("_at"),
        F.lit(0).alias("_side"),
        F.lit(None).cast(shape).alias("_left"),
        payload.alias("_right"),
    ).unionByName(
        left.select(
            *keys,
            F.unix_micros(F.col(left_time)).alias("_at"),
            F.lit(1).alias("_side"),
            F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
            F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"),
        )
    )
    tied = F.when(F.col("_side") == 0, F.xxhash64("_right")).otherwise(F.xxhash64("_left"))
    # Stored before they are sampled for the cuts, as sampling goes through all rows once more; the cuts are drawn once.
    runs = cut_lineage(events.withColumn("_tie", tied)).repartitionByRange(*keys, "_at", "_side", "_tie")
    laid = cut_lineage(runs.withColumn("_run", F.spark_partition_id()))
    joined = carry_forward(
        laid, keys, "_at", F.col("_right"), into, tie=[F.col("_side"), F.col("_tie")], bucket_of=F.col("_run")
    )
    return joined.filter(F.col("_side") == 1).select("_left.*", into)


def running_rank(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Sequence[str],
    fine: str,
    into: str,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """1-based position of each row in its key by ``(*coarse, fine)``.

    ``fine`` is a whole number that is unique in the key, so a bucket holds at
    most ``width`` rows; positions add up the sizes of the earlier buckets.
    """
    keys = list(keys)
    bucket = [*keys, *coarse, "_bucket"]
    rows = df.withColumn("_bucket", F.floor(F.col(fine) / F.lit(width)))
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("_size"))
    before = (
        Window.partitionBy(*keys).orderBy(*coarse, "_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    local = rows.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*bucket).orderBy(fine))
    )
    return local.join(offsets, same_key(local, offsets, bucket)).select(
        *[local[c] for c in df.columns], (F.col("_offset") + F.col("_local")).alias(into)
    )


def substrings(text: Column, length: int) -> Column:
    """All overlapping pieces of the given length, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % length), F.lit(1))


def contains_join(
    texts: DataFrame, text: str, needles: DataFrame, needle: str, seed: int = 4
) -> DataFrame:
    """Every pair of a text and a needle that stands in it, without a cross join.

    A needle's first ``seed`` characters, or all of a shorter one, must stand
    in the text, which is an equality join; the few candidates are then checked
    in full. When there are few distinct seeds (counted first), each text only
    gives out the pieces that are seeds; otherwise all its pieces are joined.
    An empty needle stands in no text.
    """
    size = F.least(F.length(needle), F.lit(seed))
    lengths = [r[0] for r in needles.select(size.alias("n")).filter("n > 0").distinct().collect()]
    found = None
    for length in sorted(lengths, reverse=True):
        some = _contains_from(texts, text, needles.filter(size == length), needle, length)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return _contains_from(texts, text, needles.limit(0), needle, seed)
    return found


def _contains_from(texts: DataFrame, text: str, needles: DataFrame, needle: str, seed: int) -> DataFrame:
    seeded = needles.withColumn("_seed", F.substring(F.col(needle), 1, seed))
    seeds = [r[0] for r in seeded.select("_seed").distinct().limit(MAX_SEEDS + 1).collect()]
    pieces = F.array_distinct(substrings(F.col(text), seed))
    if len(seeds) <= MAX_SEEDS:
        pieces = F.array_intersect(pieces, string_array(seeds))
    return (
        texts.withColumn("_seed", F.explode(pieces))
        .join(seeded, "_seed")
        .filter(F.contains(F.col(text), F.col(needle)))
        .drop("_seed")
    )
