"""A whole crawl over stored pages: admission, sitemaps, fair turns and a page budget, round by round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaero.functions import urls as U
from quaero.operators import links as L
from quaero.operators.keyed import sent
from quaero.session import cut_lineage

# Pages that are fetched in a round, and parts that a host's rows are dealt to before they are ranked.
BATCH, SALTS = 1000, 32
FRONTIER = ["url", "host", "priority", "depth"]


def _host(url: Column) -> Column:
    name = U.host(url)
    return F.when(name == "", F.lit("unknown")).otherwise(name)


def next_pages(frontier: DataFrame, fetched: DataFrame, n: int) -> DataFrame:
    """The ``n`` pages whose turn it is: ``(*FRONTIER, place)``, place from 1.

    The host served least goes first, ties to the better head; ``fetched`` has (host, n). Only a host's first ``n`` rows can be
    among them: they are cut in parts of the host first, so that one huge host is spread over many tasks, and then together.
    """
    order = [F.asc("priority"), F.asc("depth"), F.asc("url")]
    salted = frontier.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
    heads = salted.withColumn("_first", F.row_number().over(Window.partitionBy("host", "_salt").orderBy(*order))).filter(F.col("_first") <= n)
    own = heads.withColumn("_own", F.row_number().over(Window.partitionBy("host").orderBy(*order))).filter(F.col("_own") <= n)
    turn = F.coalesce("n", F.lit(0)) + F.col("_own") - 1
    timed = own.join(fetched, "host", "left").withColumn("_turn", turn)
    chosen = timed.orderBy("_turn", "priority", "depth", "url").limit(n)
    place = F.row_number().over(Window.orderBy("_turn", "priority", "depth", "url"))
    return chosen.withColumn("place", place).select(*FRONTIER, "place")


def crawl_job(pages: DataFrame, links: DataFrame, seeds: DataFrame, hosts: DataFrame, sitemaps: DataFrame | None = None,
              max_pages: int = 100_000, max_depth: int = 25, batch: int = BATCH) -> DataFrame:
    """``(url, host, depth, round, place, status)`` of the pages that are fetched, in order.

    ``pages`` has (url, status) of what can be fetched, ``links`` (page_url, url) as read from the pages, ``seeds`` (url),
    ``hosts`` the allowlist (host), ``sitemaps`` (host, url). A page is fetched once, at the depth at which it was first named.
    Links are admitted if they are worth a visit and not too deep (documents may lie deeper); a host's sitemap joins the
    frontier when the first of its pages is fetched. Pages that are missing or answer with an error count against the budget
    and lead nowhere (status null or 400 and more).
    """
    deep = lambda rows: rows.filter((F.col("depth") <= max_depth) | U.is_document("url"))

    def entered(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
        fresh = deep(rows).groupBy("url").agg(F.min("depth").alias("depth"))
        fresh = fresh if seen is None else fresh.join(seen, "url", "left_anti")
        return fresh.select("url", _host(F.col("url")).alias("host"), U.crawl_priority("url", F.col("depth")).alias("priority"), "depth")

    named = L.allowed(seeds.select(U.normalize_url("url").alias("url")), hosts).withColumn("depth", F.lit(0))
    frontier = cut_lineage(entered(named, None))
    seen = frontier.select("url")
    fetched = frontier.select("host").limit(0).withColumn("n", F.lit(0).cast("long"))
    visited, left, turn = None, max_pages, 0
    while left > 0:
        now = cut_lineage(next_pages(frontier, fetched, min(batch, left)))
        taken = now.count()
        if not taken:
            break
        left, turn = left - taken, turn + 1
        # The few addresses of a round go to the large tables, which are neither sorted out nor shuffled as a whole.
        asked = pages.select("url", "status").join(sent(now.select("url")), "url", "left_semi")
        answered = cut_lineage(now.join(asked, "url", "left"))
        lines = answered.select("url", "host", "depth", F.lit(turn).alias("round"), "place", "status")
        visited = lines if visited is None else visited.unionByName(lines)
        # From a page, one step down; the sitemap of a host that is met for the first time lies at depth 1.
        good = answered.filter("status < 400").select(F.col("url").alias("page_url"), (F.col("depth") + 1).alias("depth"))
        read = links.join(sent(good.select("page_url")), "page_url", "left_semi")
        found = L.admit(read.join(good, "page_url").select("url", "depth"), hosts)
        if sitemaps is not None:
            first_met = now.select("host").distinct().join(fetched.select("host"), "host", "left_anti")
            listed = L.allowed(sitemaps.join(first_met, "host").select("url"), hosts).withColumn("depth", F.lit(1))
            found = found.unionByName(listed)
        fresh = cut_lineage(entered(found, seen))
        frontier = cut_lineage(frontier.join(now.select("url"), "url", "left_anti").select(*FRONTIER).unionByName(fresh))
        seen = cut_lineage(seen.unionByName(fresh.select("url")))
        served = now.groupBy("host").agg(F.count("*").alias("n"))
        fetched = cut_lineage(fetched.unionByName(served).groupBy("host").agg(F.sum("n").alias("n")))
    none = "url string, host string, depth int, round int, place int, status int"
    return visited if visited is not None else seeds.sparkSession.createDataFrame([], none)
