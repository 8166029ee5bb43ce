"""Links: admission, assets, keyword relevance, crawl counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.functions import urls as U
from quaero.operators.keyed import contains_join, first_rows, unfold
from quaero.values import patterns, words


def allowlist(seeds: DataFrame, apexes: Sequence[str] = (), always: Sequence[str] = ()) -> DataFrame:
    """``(host)``: the seeds' hosts, the apex of three-part hosts below a named apex, and ``always``."""
    hosts = seeds.select(U.host("url").alias("host")).filter("host != ''")
    apex = F.substring_index("host", ".", -2)
    parents = hosts.filter((F.size(F.split("host", r"\.")) >= 3) & apex.isin(*apexes)) if apexes else hosts.limit(0)
    extra = seeds.sparkSession.createDataFrame([(a,) for a in always], "host string")
    return hosts.unionByName(parents.select(apex.alias("host"))).unionByName(extra).distinct()


def allowed(links: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """Links whose host is listed or lies below a listed one.

    A host has few parents, so the suffix test is an equality join on them; the
    link rows come back unchanged and unrepeated.
    """
    addresses = links.select(U.host(url).alias("_host")).distinct().filter("_host != ''")
    parts = F.split("_host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    good = (
        addresses.withColumn("_parent", F.explode(parents))
        .join(hosts.select(F.col("host").alias("_parent")), "_parent", "left_semi")
        .select("_host").distinct()
    )
    marked = links.withColumn("_host", U.host(url))
    return marked.join(good, "_host", "left_semi").drop("_host")


def admit(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """Links worth a visit: allowed, on the web, not an asset or an endpoint."""
    return allowed(links.filter(U.is_crawlable("url")), hosts)


def urls_in_assets(texts: DataFrame, keys: Sequence[str], base: str = "url", text: str = "content") -> DataFrame:
    """``(*keys, url, found_pos)``: addresses inside scripts and style sheets, first mention wins."""
    body = T.text_or_empty(text)
    word = "(?iU)"
    found = [
        F.regexp_extract_all(body, F.lit((word if i != 2 else "") + p), F.lit(1))
        for i, p in enumerate(patterns.ASSET_URLS)
    ]
    refs = unfold(texts.withColumn("_base", F.col(base)), [*keys, "_base"], F.concat(*found), "_at", "_ref")
    trimmed = F.rtrim(F.rtrim(T.strip(F.col("_ref")), F.lit("\\")), F.lit(".,);]"))
    useful = refs.withColumn("_ref", trimmed).filter((F.col("_ref") != "") & U.is_useful_reference(F.col("_ref")))
    made = useful.withColumn("_full", U.resolve("_base", "_ref")).filter("_full is not null")
    named = made.withColumn("url", U.normalize_url("_full")).filter(
        ~T.ends_with_any(U.raw_path(F.col("url")), words.ASSET_EXTENSIONS)
    )
    return named.groupBy(*keys, "url").agg(F.min("_at").alias("found_pos"))


def links_from_assets(extracted: DataFrame, assets: DataFrame, max_assets: int = 12,
                      max_links: int = 200, max_chars: int = 2_000_000) -> DataFrame:
    """``(page_id, url, anchor)``: links found in the assets of each page.

    ``assets`` has (asset_url, status, content). Each asset is read once,
    however many pages name it; per page the first assets and links count.
    """
    named = extracted.select("page_id", F.col("url").alias("page_url"), F.posexplode("assets").alias("asset_pos", "asset_url"))
    named = named.filter(F.col("asset_pos") < max_assets)
    wanted = named.select("asset_url").distinct()
    bodies = assets.filter((F.col("status") < 400) & (F.length("content") > 0)).join(wanted, "asset_url", "left_semi")
    texts = bodies.select("asset_url", F.substring("content", 1, max_chars).alias("content"))
    inside = urls_in_assets(texts, ["asset_url"], base="asset_url")
    kind = F.when(F.contains(F.lower("asset_url"), F.lit(".css")), "from-css").otherwise("from-js")
    rows = named.join(inside, "asset_url").filter("url != page_url").withColumn("anchor", kind)
    order = F.struct("asset_pos", "found_pos")
    unique = rows.groupBy("page_id", "url").agg(
        F.min(order).alias("_first"), F.min_by("anchor", order).alias("anchor")
    )
    return first_rows(unique, ["page_id"], [F.asc("_first"), F.asc("url")], max_links).drop("_first")


def keyword_table(spark: SparkSession, stems: Sequence[str] | DataFrame, topics: Sequence[str] = (),
                  suffixes: Sequence[str] = (), joints: Sequence[str] = tuple(words.KEYWORD_JOINTS)) -> DataFrame:
    """``(keyword, keyword_pos)``: stems, their shorter forms, and each topic with each suffix.

    A stem of more than four letters that ends in a, ă, e or i also counts
    without that letter. The stems are the caller's; see ``values.words`` for
    topics and suffixes.
    """
    if not isinstance(stems, DataFrame):
        stems = spark.createDataFrame([(s, i) for i, s in enumerate(stems)], "stem string, at long")
    low = F.lower(T.strip(F.col("stem")))
    shorter = F.when(low.rlike("[aăei]$") & (F.length(low) > 4), F.array(low, F.substring(low, F.lit(1), F.length(low) - 1)))
    forms = stems.select(
        F.posexplode(F.coalesce(shorter, F.array(low))).alias("form", "keyword"), F.col("at").cast("long").alias("at")
    ).select(F.lit(0).alias("part"), "at", "form", "keyword")
    pairs = [f"{t}{j}{s}" for t in topics for s in suffixes for j in joints]
    combined = spark.createDataFrame(
        [(1, i, 0, k) for i, k in enumerate(pairs)], "part int, at long, form int, keyword string"
    )
    every = forms.unionByName(combined).filter(F.length("keyword") >= 2)
    return every.groupBy("keyword").agg(F.min(F.struct("part", "at", "form")).alias("keyword_pos"))


def keyword_hits(links: DataFrame, keywords: DataFrame, limit: int = 20) -> DataFrame:
    """``(url, anchor, hits, relevant)``: the first keywords in each address with its anchor."""
    blob = F.lower(F.concat_ws(" ", T.text_or_empty("url"), T.text_or_empty("anchor")))
    distinct = links.select("url", "anchor").distinct().withColumn("_blob", blob)
    found = [
        contains_join(distinct, "_blob", keywords.filter(F.length("keyword") >= size)
                      .filter(F.length("keyword") < nxt), "keyword", seed=size)
        for size, nxt in ((2, 3), (3, 4), (4, 1_000_000))
    ]
    hits = found[0].unionByName(found[1]).unionByName(found[2])
    per = first_rows(hits, ["url", "anchor"], [F.asc("keyword_pos")], limit).groupBy("url", "anchor").agg(
        F.array_sort(F.collect_list(F.struct("keyword_pos", "keyword"))).alias("_hits")
    )
    per = per.withColumnsRenamed({"url": "_url", "anchor": "_anchor"})
    same = F.col("url").eqNullSafe(F.col("_url")) & F.col("anchor").eqNullSafe(F.col("_anchor"))
    return distinct.join(per, same, "left").select(
        "url", "anchor",
        F.coalesce(F.transform("_hits", lambda h: h["keyword"]), T.string_array([])).alias("hits"),
        F.col("_hits").isNotNull().alias("relevant"),
    )


def crawl_counters(fetched: DataFrame, kind: Column, outcome: Column) -> DataFrame:
    return fetched.groupBy(kind.alias("kind"), outcome.alias("outcome")).agg(F.count("*").alias("n"))
