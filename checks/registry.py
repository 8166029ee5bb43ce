"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.sources.tables import read_table

# Tables that texts are read or made from, and what tells their rows apart.
TEXTS = {
    "documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"],
    "lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"],
}

@dataclass(frozen=True)
class Reader:
    """The tables of a folder by name."""

    spark: SparkSession
    folder: str

    def __call__(self, table: str) -> DataFrame:
        return read_table(self.spark, self.folder, table, TEXTS.get(table, ()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table reader under ``name``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.unionOutputPartitioning", "false")
            return fn(Reader(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def joined(column, separator: str = "|"):
    """An array as one text, so that both engines show it alike."""
    return F.array_join(column, separator)
