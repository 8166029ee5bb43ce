"""A stored table that is changed by small segments and merged when it is read.

Rows lie in ``rows``, dealt to parts by a hash of their key; a narrow log of keys lies beside them in ``keys``, and ``gone`` marks
what a segment takes out of the segments before it. An upsert reads the key log, writes the rows that changed, and touches
nothing else; a reader leaves out the marked rows. Compaction writes the live rows of parts in which too much is gone into one
new segment, which becomes the base of those parts. A segment counts once its line in the manifest is written, and writing it
again replaces it: a job that is run again after a failure ends in the same table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.session import cut_lineage

PARTS = 64
# Segments are numbered in steps, so that compactions find room between two of them.
STEP = 1000
# A part is rewritten when so many of its rows are gone.
GONE_SHARE = 0.25


@dataclass
class MergeTable:
    """The table in folder ``path``: rows of ``schema`` that are replaced together if they have the same ``key``.

    ``narrow`` names columns that the key log holds, too: what is needed to find changes without reading rows.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str
    narrow: list[str] = field(default_factory=list)
    parts: int = PARTS

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def _kinds(self, names: list[str]) -> str:
        return ", ".join(c for c in self.schema.split(", ") if c.split()[0] in names)

    @property
    def _schemas(self) -> dict[str, str]:
        where = "segment long, part int"
        return {
            "rows": f"{self.schema}, {where}", "keys": f"{self._kinds([self.key, *self.narrow])}, deleted boolean, n_rows long, {where}",
            "gone": f"{self._kinds([self.key])}, upto long, n_rows long, {where}",
            "manifest": "base array<int>, segment long",
        }

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int").alias("part")

    def _read(self, name: str) -> DataFrame:
        schema = self._schemas[name]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # only a part that is not there yet is empty
                raise
            return self.spark.createDataFrame([], schema)

    def segments(self) -> list[int]:
        return sorted(r["segment"] for r in self._read("manifest").select("segment").collect())

    def _bases(self) -> dict[int, int]:
        """The segment from which each part is read: the last one that rewrote it."""
        lines = self._read("manifest").select("segment", F.explode("base").alias("part")).groupBy("part").agg(F.max("segment").alias("segment"))
        return {r["part"]: r["segment"] for r in lines.collect()}

    def _valid(self, name: str, before: int | None = None) -> DataFrame:
        """Rows of the segments that count, each part from its base on; both are columns of folders, so others are not read."""
        segments = [s for s in self.segments() if before is None or s < before]
        bases = {part: s for part, s in self._bases().items() if before is None or s < before}
        rows = self._read(name).filter(F.col("segment").isin(segments))
        for part, segment in bases.items():
            rows = rows.filter((F.col("part") != part) | (F.col("segment") >= segment))
        return rows

    def keys(self, before: int | None = None) -> DataFrame:
        """``(key, narrow columns, n_rows, segment, part)`` of all live keys."""
        last = self._valid("keys", before).groupBy(self.key).agg(
            F.max(F.struct("segment", *self.narrow, "deleted", "n_rows", "part")).alias("_last")
        )
        return last.select(self.key, "_last.*").filter(~F.col("deleted")).drop("deleted")

    def current(self, before: int | None = None) -> DataFrame:
        """The rows as they stand, or as they stood before a segment."""
        rows = self._valid("rows", before)
        gone = self._valid("gone", before).select(F.col(self.key).alias("_key"), "upto").groupBy("_key").agg(F.max("upto").alias("_upto"))
        if gone.isEmpty():
            return rows.select(*self.columns)
        taken = (F.col(self.key) == F.col("_key")) & (F.col("segment") <= F.col("_upto"))
        return rows.join(gone, taken, "left_anti").select(*self.columns)

    def _write(self, df: DataFrame, name: str, segment: int) -> None:
        # Parts of any size: large ones are split over tasks, small ones share one.
        df.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}/segment={segment}")

    def apply(self, rows: DataFrame, removed: DataFrame | None = None, segment: int | None = None) -> int:
        """Replace the rows of all keys in ``rows`` and take out the keys in ``removed``; returns the segment.

        A null key is never found again: such rows are added each time.
        """
        segment = (max(self.segments(), default=0) // STEP + 1) * STEP if segment is None else segment
        known = self.keys(before=segment).select(self.key, F.col("segment").alias("upto"), F.col("n_rows"))
        placed = rows.select(*self.columns).withColumn("part", self._part())
        self._write(placed, "rows", segment)
        written = self.spark.read.schema(_without(self._schemas["rows"], "segment")).parquet(f"{self.path}/rows/segment={segment}")
        per_key = written.groupBy(self.key, "part").agg(*[F.max(c).alias(c) for c in self.narrow], F.count(F.lit(1)).alias("n_rows"))
        lines = per_key.withColumn("deleted", F.lit(False))
        touched = per_key.select(self.key)
        if removed is not None:
            out = removed.select(self.key).distinct().join(touched, self.key, "left_anti").join(known.select(self.key), self.key, "left_semi")
            nothing = [F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in self._kinds(self.narrow).split(", ") if k]
            dead = out.select(self.key, self._part(), *nothing, F.lit(0).cast("long").alias("n_rows"), F.lit(True).alias("deleted"))
            lines, touched = lines.unionByName(dead), touched.unionByName(out)
        self._write(known.join(touched, self.key, "left_semi").withColumn("part", self._part()), "gone", segment)
        self._write(lines, "keys", segment)
        self._commit(segment, [])
        return segment

    def _commit(self, segment: int, base: list[int]) -> None:
        line = self.spark.createDataFrame([(base,)], "base array<int>")
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/segment={segment}")

    def gone_shares(self) -> dict[int, float]:
        """The share of each part's stored rows that are gone: from the logs, no row is read."""
        stored = self._valid("keys").groupBy("part").agg(F.sum("n_rows").alias("stored"))
        gone = self._valid("gone").groupBy("part").agg(F.sum("n_rows").alias("gone"))
        shares = stored.join(gone, "part", "left").select("part", (F.coalesce("gone", F.lit(0)) / F.greatest("stored", F.lit(1))).alias("share"))
        return {r["part"]: r["share"] for r in shares.collect()}

    def compact(self, gone_share: float = GONE_SHARE) -> list[int]:
        """Rewrite the parts in which at least ``gone_share`` of the rows are gone; returns them. Other parts stay as they are."""
        parts = sorted(p for p, share in self.gone_shares().items() if share >= gone_share and share > 0)
        if not parts:
            return []
        segment = max(self.segments()) + 1
        chosen = F.col("part").isin(parts)
        live = self.current().withColumn("part", self._part()).filter(chosen)
        self._write(live, "rows", segment)
        lines = self.keys().filter(chosen).drop("segment").withColumn("deleted", F.lit(False))
        self._write(cut_lineage(lines), "keys", segment)
        self._write(self._read("gone").limit(0).drop("segment"), "gone", segment)
        self._commit(segment, parts)
        return parts


def _without(schema: str, column: str) -> str:
    return ", ".join(c for c in schema.split(", ") if c.split()[0] != column)
