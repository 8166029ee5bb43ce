"""The source catalogue: seed lists, insert-if-absent, crawl marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.functions import urls as U
from quaero.operators.keyed import carry_forward

# Fixed value: line starts that are neither a category nor an address.
IGNORED_STARTS = ["Source PDF", "Annex", "=", "All URLs"]
GENERAL = "general"
HEADER_CHARS = 80


def read_seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of a catalogue file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(T.lines("value")).alias("line_no", "line"))


def seed_entries(lines: DataFrame, width: int = 10_000) -> DataFrame:
    """``(url, category, line_no)``: addresses under the category line above them, first mention wins."""
    line = T.strip(F.col("line"))
    rows = lines.select(F.col("line_no").cast("long").alias("line_no"), line.alias("_line")).filter("_line != ''")
    for start in IGNORED_STARTS:
        rows = rows.filter(~F.col("_line").startswith(start))
    is_url = F.col("_line").rlike("^https?://")
    header = (
        ~F.col("_line").startswith("http") & ~F.col("_line").contains("====")
        & ~F.col("_line").startswith("Primăria") & (F.length("_line") < HEADER_CHARS)
    )
    filled = carry_forward(
        rows, [], "line_no", F.when(header, F.col("_line")), "_category", include_current=True, width=width
    )
    url = F.regexp_replace(F.rtrim("_line", F.lit("/")), "#.*$", "")
    entries = filled.filter(is_url).select(
        "line_no", url.alias("url"), F.coalesce("_category", F.lit(GENERAL)).alias("category")
    )
    return entries.groupBy("url").agg(
        F.min_by("category", "line_no").alias("category"), F.min("line_no").alias("line_no")
    )


def missing_sources(sources: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Arrivals that are no known source, by code first and then by address.

    ``arrivals`` has (url, name, category, priority, type, seq). Arrivals that
    share a code or an address with an earlier one are that source.
    """
    coded = arrivals.withColumn("code", U.source_code("url"))
    rest = [c for c in coded.columns if c not in ("code", "url")]
    by_code = coded.groupBy("code").agg(F.min_by(F.struct("url", *rest), "seq").alias("_row")).select("code", "_row.*")
    by_url = by_code.groupBy("url").agg(F.min_by(F.struct("code", *rest), "seq").alias("_row")).select("url", "_row.*")
    new = by_url.join(sources.select("code"), "code", "left_anti").join(sources.select("url"), "url", "left_anti")
    return new.select(
        "code", F.coalesce("name", F.nullif(U.host("url"), F.lit("")), F.col("url")).alias("name"), "url",
        "type", "category", F.lit("both").alias("language"), "priority", F.lit(True).alias("active"),
    )


def insert_absent(table: DataFrame, arrivals: DataFrame, key: str) -> DataFrame:
    """The table with those arrivals whose key it lacks."""
    return table.unionByName(arrivals.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def crawl_seeds(seeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Catalogue seeds and the active sources whose normalized address is not among them.

    ``(url, category, seq)``; sources come after the seeds, by id.
    """
    own = seeds.select("url", "category", F.col("line_no").alias("_order"), F.lit(0).alias("_list"))
    active = sources.filter(F.col("active") & (F.coalesce("url", F.lit("")) != "")).select(
        U.normalize_url("url").alias("url"), F.coalesce("category", F.lit("db-source")).alias("category"),
        F.col("source_id").alias("_order"),
    )
    unique = active.groupBy("url").agg(F.min_by("category", "_order").alias("category"), F.min("_order").alias("_order"))
    known = seeds.select(U.normalize_url("url").alias("url")).distinct()
    extra = unique.join(known, "url", "left_anti").withColumn("_list", F.lit(1))
    return own.unionByName(extra).select(
        "url", "category", F.struct(F.col("_list").alias("list"), F.col("_order").alias("order")).alias("seq")
    )


def mark_crawled(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """Sources with their latest crawl; ``fetched`` has (source_id, fetched_at)."""
    last = fetched.groupBy("source_id").agg(F.max("fetched_at").alias("_last"))
    return sources.join(last, "source_id", "left").withColumn(
        "last_crawled_at", F.greatest("last_crawled_at", "_last")
    ).drop("_last")


def paged_content(pages: Column) -> Column:
    """Pages joined under their page marks, empty ones left out."""
    from quaero.values.replies import PAGE_MARK

    marked = F.transform(
        pages, lambda p, i: F.when(
            T.strip(p) != "", F.concat(F.format_string(PAGE_MARK, (i + 1).cast("string")), F.lit("\n"), T.strip(p))
        )
    )
    return F.array_join(F.filter(marked, lambda p: p.isNotNull()), "\n\n")


def new_seed_documents(seeds: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Seed documents that are not stored with the same title and text, or have no chunks yet.

    ``seeds`` has (title, url, pages array<string>, ...).
    """
    hashed = seeds.withColumn("content", paged_content(F.col("pages"))).withColumn(
        "content_hash", T.content_hash("content")
    )
    indexed = documents.join(chunks.select("document_id").distinct(), "document_id", "left_semi")
    return hashed.join(indexed.select("title", "content_hash"), ["title", "content_hash"], "left_anti")
