"""The crawl frontier as a table: adding, fair order, budgets, sitemaps, traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.functions import urls as U
from quaero.operators.keyed import first_rows, running_rank
from quaero.session import cut_lineage
from quaero.values import words


def add(frontier: DataFrame, seen: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The frontier with the arrivals not seen before; of equal addresses the first wins.

    Frames have (url, priority, depth, seq); ``seen`` has (url) and includes the frontier.
    """
    first = arrivals.groupBy("url").agg(F.min_by(F.struct("priority", "depth", "seq"), "seq").alias("_row"))
    fresh = first.select("url", "_row.*").join(seen.select("url"), "url", "left_anti")
    return frontier.select("url", "priority", "depth", "seq").unionByName(
        fresh.select("url", "priority", "depth", "seq")
    )


def fair_order(frontier: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """Adds ``turn``: how often its host has been served when a row's time comes.

    Rows are popped by (turn, priority): the host served least goes first, ties
    to the better head. ``fetched`` has (host, n). A host's rows are numbered in
    bounded buckets, so one huge host is spread over many tasks.
    """
    hosted = frontier.withColumn(
        "host", F.when(U.host("url") == "", F.lit("unknown")).otherwise(U.host("url"))
    )
    numbered = running_rank(hosted, ["host"], ["priority", "depth"], "seq", "_position")
    if fetched is None:
        return numbered.withColumn("turn", F.col("_position") - 1).drop("_position")
    joined = numbered.join(fetched.select("host", F.col("n").alias("_n")), "host", "left")
    return joined.withColumn("turn", F.coalesce("_n", F.lit(0)) + F.col("_position") - 1).drop("_position", "_n")


def pop(frontier: DataFrame, n: int, fetched: DataFrame | None = None) -> DataFrame:
    """The next ``n`` rows. Only a host's first ``n`` rows can be among them."""
    hosted = frontier.withColumn(
        "host", F.when(U.host("url") == "", F.lit("unknown")).otherwise(U.host("url"))
    )
    heads = first_rows(hosted, ["host"], [F.asc("priority"), F.asc("depth"), F.asc("seq")], n, "_position")
    if fetched is None:
        turn = heads.withColumn("turn", F.col("_position").cast("long") - 1)
    else:
        turn = heads.join(fetched.select("host", F.col("n").alias("_n")), "host", "left").withColumn(
            "turn", F.coalesce("_n", F.lit(0)).cast("long") + F.col("_position") - 1
        ).drop("_n")
    return turn.drop("_position").orderBy("turn", "priority", "depth", "seq").limit(n)


def within_depth(frontier: DataFrame, max_depth: int) -> DataFrame:
    """Rows within the depth; documents may lie deeper."""
    return frontier.filter((F.col("depth") <= max_depth) | U.is_document("url"))


# --- sitemaps --------------------------------------------------------------------------

def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """``(host, url)`` of the ``Sitemap:`` lines; ``robots`` has (host, status, content)."""
    rows = robots.filter("status < 400").select("host", F.explode(T.lines("content")).alias("_line"))
    named = rows.filter(F.lower("_line").startswith("sitemap:"))
    value = T.strip(F.regexp_replace("_line", "^[^:]*:", ""))
    return named.select("host", U.normalize_url(value).alias("url")).distinct()


def usual_sitemaps(hosts: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """``(host, url)`` of the usual places; hosts whose robots file names one skip two of them."""
    paths = words.SITEMAP_PATHS
    base = hosts.select("host", F.explode(T.string_array(paths)).alias("_path"))
    if named is not None:
        known = named.select("host").distinct().withColumn("_named", F.lit(True))
        base = base.join(known, "host", "left").filter(F.col("_named").isNull() | ~F.col("_path").isin(paths[2:4]))
    return base.select("host", F.concat(F.lit("https://"), "host", "_path").alias("url"))


def locations(xml: Column) -> Column:
    """Addresses in the ``<loc>`` elements of a sitemap."""
    raw = F.regexp_extract_all(T.text_or_empty(xml), F.lit("(?s)<loc>((?:(?!<loc>).)*?)</loc>"), F.lit(1))
    trimmed = F.transform(raw, T.strip)
    return F.transform(F.filter(trimmed, lambda u: u.startswith("http")), lambda u: U.normalize_url(u))


def is_sitemap(url: Column) -> Column:
    low = F.lower(url)
    return low.endswith(".xml") | low.contains("/sitemap") | F.substring_index(low, "/", -1).contains("sitemap")


def harvest_sitemaps(roots: DataFrame, stored: DataFrame, cap: int = 8000) -> DataFrame:
    """``(host, url)``: pages named by each host's sitemaps and those they point to.

    ``roots`` has (host, url), ``stored`` (url, status, content). Every round
    reads the sitemaps not read before, until none is left; per host the first
    ``cap`` pages, by round and address, are kept.
    """
    bodies = stored.filter((F.col("status") < 400) & (F.length("content") > 0)).select("url", "content")
    todo = cut_lineage(roots.select("host", "url").distinct())
    tried, pages, step = todo, None, 0
    while not todo.isEmpty():  # each round reads only what none has read, so it ends
        inside = todo.join(bodies, "url").select("host", F.explode(locations(F.col("content"))).alias("url")).distinct()
        inside = cut_lineage(inside.withColumn("_map", is_sitemap(F.col("url"))))
        found = inside.filter(~F.col("_map")).select("host", "url", F.lit(step).alias("_round"))
        pages = found if pages is None else pages.unionByName(found)
        todo = cut_lineage(inside.filter("_map").select("host", "url").join(tried, ["host", "url"], "left_anti"))
        tried = tried.unionByName(todo)
        step += 1
    if pages is None:
        return roots.select("host", "url").limit(0)
    unique = pages.groupBy("host", "url").agg(F.min("_round").alias("_round"))
    return first_rows(unique, ["host"], [F.asc("_round"), F.asc("url")], cap).select("host", "url")


# --- traversal -------------------------------------------------------------------------

def crawl(links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """``(url, depth)``: stored pages reached from the seeds, each at its least depth.

    ``links`` has (page_url, url). Each round joins the newest pages, which are
    unique, with the links and drops what was reached before; lineage is cut in
    the shared folder. Documents may be reached one round beyond the depth.
    """
    reached = cut_lineage(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    newest = reached
    for depth in range(1, max_depth + 2):
        step = (
            links.join(newest.select(F.col("url").alias("page_url")), "page_url", "left_semi")
            .select("url").distinct()
        )
        if depth > max_depth:
            step = step.filter(U.is_document("url"))
        newest = cut_lineage(
            step.join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        )
        if newest.isEmpty():
            break
        reached = reached.unionByName(newest)
    if max_pages is None:
        return reached
    ranked = reached.withColumn("priority", U.crawl_priority("url", F.col("depth")))
    return ranked.orderBy("depth", "priority", "url").limit(max_pages).drop("priority")
