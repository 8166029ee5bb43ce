"""The n-th smallest value of each key, found by counting.

Each round counts a key's values in bins between the smallest and the largest that may still be the one, and goes on inside the
bin that holds the rank. Counts are added up in the tasks first, so a key's state is its bins, however many values it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaero.session import cut_lineage

BINS = 1024
# A bin with so many values or fewer is sorted.
SORTED = 4096


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """``left`` joined with ``right`` by keys that may be null; the keys of ``left`` stay."""
    other = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True))
    return left.join(other, same if also is None else same & also, how).drop(*[f"_r_{k}" for k in keys])


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, bins: int = BINS, most: int = SORTED) -> DataFrame:
    """``(*keys, rank, value)``: of each key the value that has ``rank`` smaller or equal ones before it in ascending order.

    ``ranks`` has (*keys, rank), ranks from 0; ranks that a key does not reach and null values do not count.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    whole = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    asked = ranks.select(*keys, F.col("rank").cast("long").alias("rank")).distinct()
    open_ = beside(asked, whole, keys).withColumn("_left", F.col("rank"))
    open_ = cut_lineage(open_.filter("rank >= 0 and rank < _n"))
    done = None
    while True:
        flat = open_.filter("_low = _high").select(*keys, "rank", F.col("_low").alias("value"))
        done = flat if done is None else done.unionByName(flat)
        open_ = open_.filter("_low < _high")
        small = open_.filter(F.col("_n") <= most)
        large = cut_lineage(open_.filter(F.col("_n") > most))
        found = _within(rows, small, keys)
        order = Window.partitionBy(*keys, "rank").orderBy("_v")
        at = F.row_number().over(order) - 1
        done = done.unionByName(found.withColumn("_at", at).filter(F.col("_at") == F.col("_left")).select(*keys, "rank", F.col("_v").alias("value")))
        if large.isEmpty():
            return done
        width = F.col("_high") - F.col("_low")
        # Halves, so that the width of bins is finite for values of opposite signs near the largest double.
        share = F.when(width < float("inf"), (F.col("_v") - F.col("_low")) / width).otherwise(
            (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        )
        number = F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")
        counted = _within(rows, large, keys).groupBy(*keys, "rank", "_left", number.alias("_bin")).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        upto = Window.partitionBy(*keys, "rank").orderBy("_bin")
        before = F.sum("_n").over(upto) - F.col("_n")
        held = counted.withColumn("_before", before).filter((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_n")))
        open_ = cut_lineage(held.select(*keys, "rank", (F.col("_left") - F.col("_before")).alias("_left"), "_low", "_high", "_n"))


def _within(rows: DataFrame, open_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values that may still have a key's rank."""
    return beside(open_, rows, keys, also=(F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
