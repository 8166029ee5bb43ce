"""Corpus, source, change, feedback and latency reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators.keyed import first_rows
from quaero.operators.selection import beside, ranked_values
from quaero.session import cut_lineage
from quaero.values.prices import CORPUS_TARGET

APPROVED_ROLES = ["admin", "manager"]


def counts(**tables: DataFrame) -> DataFrame:
    """``(name, n)``: one row per table."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def useful_feedback(feedback: DataFrame) -> DataFrame:
    """``(feedback_total, useful_pct)``; the share is null without feedback."""
    total = F.count("*")
    useful = F.count(F.when(F.col("useful"), 1))
    return feedback.agg(
        total.alias("feedback_total"),
        F.bround(100 * useful / F.nullif(total, F.lit(0)), 1).alias("useful_pct"),
    )


def latest_crawl(sources: DataFrame) -> DataFrame:
    return sources.agg(F.max("last_crawled_at").alias("last_crawl"))


def approved_users(users: DataFrame) -> DataFrame:
    approved = F.coalesce("approved", F.lit(False)) | F.coalesce(F.col("role").isin(APPROVED_ROLES), F.lit(False))
    return users.agg(F.count("*").alias("users_total"), F.count(F.when(approved, 1)).alias("users_approved"))


def change_feed(changes: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """The newest changes of documents that still exist; titles are joined to those few only."""
    alive = changes.join(documents.select("document_id"), "document_id", "left_semi")
    newest = alive.orderBy(F.desc("detected_at"), F.desc("change_id")).limit(limit)
    return newest.join(documents.select("document_id", "title", "url"), "document_id").select(
        "change_id", F.col("title").alias("document"), "url",
        F.substring("old_hash", 1, 12).alias("old_hash"), F.substring("new_hash", 1, 12).alias("new_hash"),
        "note", "detected_at",
    )


def document_changes(changes: DataFrame, limit: int = 5) -> DataFrame:
    """Each document's newest changes, with short hashes and notes."""
    return first_rows(
        changes, ["document_id"], [F.desc("detected_at"), F.desc("change_id")], limit, "place"
    ).select(
        "document_id", "place", F.substring("old_hash", 1, 10).alias("old"),
        F.substring("new_hash", 1, 10).alias("new"),
        F.substring(T.text_or_empty("note"), 1, 200).alias("note"), "detected_at",
    )


def search_documents(documents: DataFrame, text: str | None = None, limit: int = 80) -> DataFrame:
    """The newest documents whose title or address holds the text."""
    found = documents
    if text:
        like = f"%{text}%"
        found = documents.filter(F.col("title").ilike(like) | F.col("url").ilike(like))
    return found.orderBy(F.desc("document_id")).limit(limit)


def recent_documents(documents: DataFrame, limit: int = 8) -> DataFrame:
    return documents.select("document_id", "title", "url", "mime_type").orderBy(F.desc("document_id")).limit(limit)


def sources_with_counts(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """All sources with their number of documents, by priority, newest first.

    Documents are counted before the join, so a source with most of them is one row.
    """
    per = documents.groupBy("source_id").agg(F.count("*").alias("documents"))
    return sources.join(per, "source_id", "left").withColumn(
        "documents", F.coalesce("documents", F.lit(0))
    ).orderBy("priority", F.desc("source_id"))


def source_coverage(sources: DataFrame, documents: DataFrame, newest: int = 40, limit: int = 10) -> DataFrame:
    """Of the newest sources, those with the most documents."""
    few = sources.orderBy(F.desc("source_id")).limit(newest)
    per = documents.join(F.broadcast(few.select("source_id")), "source_id", "left_semi").groupBy("source_id").agg(
        F.count("*").alias("documents")
    )
    return few.join(per, "source_id", "left").select(
        "source_id", "name", "url", F.coalesce("documents", F.lit(0)).alias("documents"), "priority"
    ).orderBy(F.desc("documents"), F.desc("source_id")).limit(limit)


def feedback_list(feedback: DataFrame, limit: int = 50) -> DataFrame:
    return feedback.orderBy(F.desc("created_at"), F.desc("feedback_id")).limit(limit)


def latency_summary(runs: DataFrame, keys: tuple[str, ...] = (), wall: str = "wall_ms", exact: bool = True) -> DataFrame:
    """Completed and failed runs, median, maximum and nearest-rank p95.

    A failed run has no time. Exact ranks are found by counting (``selection``),
    so no key holds its times; ``exact=False`` uses a sketch of fixed size.
    """
    totals = [
        F.count(wall).alias("completed"), (F.count("*") - F.count(wall)).alias("failed"), F.max(wall).alias("max"),
    ]
    if not exact:
        return runs.groupBy(*keys).agg(
            *totals, F.bround(F.percentile_approx(wall, 0.5)).alias("median"), F.percentile_approx(wall, 0.95).alias("p95")
        ).select(*keys, "completed", "failed", "median", "max", "p95")
    keyed = runs if keys else runs.withColumn("_all", F.lit(1))
    by = list(keys) or ["_all"]
    counts = cut_lineage(keyed.groupBy(*by).agg(*totals))
    last = F.col("completed") - 1
    # The two middle values and the nearest rank to 95 percent.
    places = F.array(F.floor(last / 2), F.ceil(last / 2), F.ceil(F.col("completed") * 0.95).cast("long") - 1)
    asked = counts.filter("completed > 0").select(*by, F.posexplode(places).alias("_what", "rank"))
    found = ranked_values(keyed, by, wall, asked)
    told = beside(asked.select(*by, "_what", "rank"), found, [*by, "rank"]).groupBy(*by).pivot("_what", [0, 1, 2]).agg(F.first("value"))
    kind = runs.schema[wall].dataType
    return beside(counts, told, by, "left").select(
        *keys, "completed", "failed", F.bround((F.col("0") + F.col("1")) / 2).alias("median"), "max", F.col("2").cast(kind).alias("p95")
    )


def quality_flags(answer: Column, status: Column, n_sources: Column, expect_missing: Column) -> Column:
    """What is wrong with an answer."""
    return F.array_compact(
        F.array(
            F.when(T.strip(T.text_or_empty(answer)) == "", "empty_answer"),
            F.when(status.isin("supported", "conflict") & (n_sources == 0), "claim_without_source"),
            F.when(expect_missing & (status != "missing"), "invented_topic_not_marked_missing"),
        )
    )


def progress(documents: DataFrame, target: int = CORPUS_TARGET) -> DataFrame:
    n = F.count("*")
    return documents.agg(
        n.alias("documents"), F.lit(target).alias("target"),
        F.least(F.lit(100.0), F.bround(100 * n / F.lit(target), 1)).alias("progress_pct"),
        (n >= 100).alias("ready"),
    )
