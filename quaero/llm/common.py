"""Words, row numbers and stored tables shared by the operators of this subpackage."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.llm.arrow import small_batches
from quaero.session import shared_folder

# Letters, digits and everything beyond ASCII; the rest separates words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Tables of at most so many narrow rows may be broadcast (some 64 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def ascii_words(text: Column) -> Column:
    """The words of ``text`` in lower case; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number per row, so that repeated and null keys stay apart. Store the result before using it twice."""
    return df.select(F.monotonically_increasing_id().alias(name), *df.columns)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a folder of tables."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; whoever owns ``spark.checkpoint.dir`` clears it."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither repeat it nor depend on one executor."""
    folder = new_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most BROADCAST_ROWS rows (counted unless told), else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df
