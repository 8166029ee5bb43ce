"""Seeds, sources, the frontier, sitemaps and traversal."""

from __future__ import annotations


from pyspark.sql import functions as F

from checks.pages import EXTENSIONS, PATH, SKIPPED, VARIED_SQL, host, normal, varied
from checks.registry import query
from quaero.functions import urls as U
from quaero.operators import frontier, links
from quaero.plans import crawl
from quaero.sources import catalog
from quaero.values import words

# A catalogue written from the pages: a category line now and then, the page's address, a line to ignore.
LINES_SQL = """
seed_lines AS (SELECT page_id * 3 AS line_no, CASE WHEN page_id % 4 = 0 THEN '  Portal ' || page_id || ' ' WHEN page_id % 4 = 1 THEN 'Primăria nu' WHEN page_id % 4 = 2 THEN 'Source PDF: x' ELSE '' END AS line FROM pages
  UNION ALL SELECT page_id * 3 + 1, ' ' || regexp_replace(url, '/[0-9]+.*$', '') || CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '#sus' ELSE '' END FROM pages
  UNION ALL SELECT page_id * 3 + 2, '=====' FROM pages),
stripped AS (SELECT line_no, trim(line) AS line FROM seed_lines),
filled AS (SELECT *, last_value(CASE WHEN line LIKE 'Portal%' THEN line END IGNORE NULLS) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM stripped),
seeds AS (SELECT regexp_replace(rtrim(line, '/'), '#.*$', '') AS url, coalesce(arg_min(category, line_no), 'general') AS category, min(line_no)::BIGINT AS line_no
  FROM filled WHERE line LIKE 'http%' GROUP BY 1)"""


def seed_lines(t):
    p, i = t("pages"), F.col("page_id")
    header = (
        F.when(i % 4 == 0, F.concat(F.lit("  Portal "), i.cast("string"), F.lit(" "))).when(i % 4 == 1, "Primăria nu")
        .when(i % 4 == 2, "Source PDF: x").otherwise("")
    )
    end = F.when(i % 3 == 0, "/").when(i % 3 == 1, "#sus").otherwise("")
    address = F.concat(F.lit(" "), F.regexp_replace("url", "/[0-9]+.*$", ""), end)
    return (
        p.select((i * 3).alias("line_no"), header.alias("line"))
        .unionByName(p.select((i * 3 + 1).alias("line_no"), address.alias("line")))
        .unionByName(p.select((i * 3 + 2).alias("line_no"), F.lit("=====").alias("line")))
    )


@query("seed_catalogue", f"WITH {LINES_SQL} SELECT url, category, line_no FROM seeds")
def _(t):
    return catalog.seed_entries(seed_lines(t), width=50)


CODE = f"substr(lower(trim(regexp_replace(replace({host('url')}, '.', '-') || CASE WHEN substr(replace(trim({PATH}, '/'), '/', '-'), 1, 40) = '' THEN '' ELSE '-' || substr(replace(trim({PATH}, '/'), '/', '-'), 1, 40) END, '[^a-zA-Z0-9_-]+', '-', 'g'), '-')), 1, 64)"


@query("sources_if_absent", f"""
WITH known AS (SELECT {CODE} AS code, url FROM pages WHERE page_id % 3 = 0),
arrivals AS (SELECT {CODE} AS code, url, page_id FROM pages),
per_code AS (SELECT code, arg_min(url, page_id) AS url, min(page_id) AS page_id FROM arrivals GROUP BY code),
per_url AS (SELECT arg_min(code, page_id) AS code, url FROM per_code GROUP BY url)
SELECT code, url, {host('url')} AS name, 'P1' AS priority FROM per_url WHERE code NOT IN (SELECT code FROM known) AND url NOT IN (SELECT url FROM known)""")
def _(t):
    pages = t("pages")
    known = pages.filter("page_id % 3 = 0").select(U.source_code("url").alias("code"), "url")
    arrivals = pages.select(
        "url", F.lit(None).cast("string").alias("name"), F.lit("crawl").alias("category"), F.lit("P1").alias("priority"),
        F.lit("portal").alias("type"), F.col("page_id").alias("seq"),
    )
    return catalog.missing_sources(known, arrivals).select("code", "url", "name", "priority")


@query("insert_if_absent", """
SELECT n_name, n_nationkey::BIGINT AS n_nationkey, n_regionkey < 2 AS old FROM nation""")
def _(t):
    nations = t("nation").select("n_name", F.col("n_nationkey").cast("long"), (F.col("n_regionkey") < 2).alias("old"))
    return catalog.insert_absent(nations.filter("old"), nations, "n_name")


@query("crawl_seed_union", f"""
WITH {LINES_SQL}, known AS (SELECT DISTINCT {normal('url')} AS url FROM seeds),
active AS (SELECT {normal('url')} AS url, page_id FROM pages WHERE page_id % 3 <> 0),
extra AS (SELECT url, 'source ' || min(page_id) AS category FROM active WHERE url NOT IN (SELECT url FROM known) GROUP BY url)
SELECT url, category FROM seeds UNION ALL SELECT url, category FROM extra""")
def _(t):
    sources = t("pages").select(
        F.col("page_id").alias("source_id"), "url", (F.col("page_id") % 3 != 0).alias("active"),
        F.concat(F.lit("source "), F.col("page_id").cast("string")).alias("category"),
    )
    return catalog.crawl_seeds(catalog.seed_entries(seed_lines(t)), sources).select("url", "category")


@query("source_crawl_marks", """
SELECT s_suppkey AS source_id, epoch_us(greatest(TIMESTAMP '2024-01-02 00:00:00', max(ts)))::BIGINT AS last_us
FROM supplier LEFT JOIN events ON user_id = s_suppkey GROUP BY s_suppkey""")
def _(t):
    sources = t("supplier").select(
        F.col("s_suppkey").alias("source_id"), F.to_timestamp(F.lit("2024-01-02 00:00:00")).alias("last_crawled_at")
    )
    fetched = t("events").select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("fetched_at"))
    marked = catalog.mark_crawled(sources, fetched)
    return marked.select("source_id", F.unix_micros("last_crawled_at").alias("last_us"))


@query("seed_documents", r"""
WITH p AS (SELECT doc_id, string_split(text, E'\n') AS ps FROM documents),
c AS (SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(ps) + 1), lambda i: trim(ps[i], E' \t\r') <> ''), lambda i: '--- Pagina ' || i || E' ---\n' || trim(ps[i], E' \t\r')), E'\n\n') AS content FROM p),
h AS (SELECT doc_id, content, sha256(regexp_replace(trim(content, E' \t\n\r'), '\s+', ' ', 'g')) AS content_hash FROM c)
SELECT doc_id AS document_id, content_hash FROM h WHERE NOT (doc_id % 2 = 0 AND doc_id % 4 = 0)""")
def _(t):
    seeds = t("documents").select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"),
        F.split("text", "\n").alias("pages"),
    )
    from quaero.functions import text as T

    content = catalog.paged_content(F.col("pages"))
    stored = seeds.filter("document_id % 2 = 0").select("document_id", "title", T.content_hash(content).alias("content_hash"))
    chunks = seeds.filter("document_id % 4 = 0").select("document_id")
    return catalog.new_seed_documents(seeds, stored, chunks).select("document_id", "content_hash")


APEX = ["example.com", "example.net"]


@query("allowlist_build", f"""
WITH h AS (SELECT DISTINCT {host('url')} AS host FROM pages)
SELECT host FROM h UNION SELECT array_to_string(string_split(host, '.')[-2:], '.') FROM h
 WHERE len(string_split(host, '.')) >= 3 AND array_to_string(string_split(host, '.')[-2:], '.') IN ('example.com', 'example.net') UNION SELECT 'portal.example.org'""")
def _(t):
    return links.allowlist(t("pages"), APEX, ["portal.example.org"])


@query("allowlist_match", f"""
WITH apex AS (SELECT DISTINCT regexp_replace({host('url')}, '^(m|blog)\\.', '') AS host FROM pages WHERE page_id % 5 = 0)
SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM apex WHERE {host('p.url')} = apex.host OR ends_with({host('p.url')}, '.' || apex.host))""")
def _(t):
    apex = t("pages").filter("page_id % 5 = 0").select(F.regexp_replace(U.host("url"), r"^(m|blog)\.", "").alias("host"))
    return links.allowed(t("pages"), apex).select("page_id")


@query("link_admission", f"""
WITH {VARIED_SQL} SELECT page_id FROM varied WHERE NOT regexp_matches(lower({PATH}), '{SKIPPED}')
 AND (ends_with({host('url')}, '.example.com') OR ends_with({host('url')}, '.example.net'))""")
def _(t):
    hosts = t("region").sparkSession.createDataFrame([(a,) for a in APEX], "host string")
    return links.admit(varied(t), hosts).select("page_id")


PRIORITY = f"""CASE WHEN regexp_matches(lower({PATH}), '({EXTENSIONS})$') THEN depth - 20 ELSE 40 + depth * 8
  - CASE WHEN regexp_matches(lower(url), '{"|".join(words.PRIORITY_WORDS)}') THEN 20 ELSE 0 END
  - CASE WHEN regexp_matches(lower(url), '{"|".join(words.ANNOUNCEMENT_WORDS)}') THEN 15 ELSE 0 END
  - CASE WHEN len(rtrim(url, '/')) - len(replace(rtrim(url, '/'), '/', '')) <= 3 THEN 5 ELSE 0 END END"""
# Few hosts with many rows each, and one with a third of all of them.
QUEUE_SQL = f"""
queue AS (SELECT o_orderkey AS seq, 'https://' || CASE WHEN o_orderkey % 3 = 0 THEN 'big' ELSE 'h' || (o_custkey % 40) END || '.example.org/p/' || o_orderkey || CASE WHEN o_orderkey % 11 = 0 THEN '.pdf' ELSE '' END AS url, (o_custkey % 4)::INT AS depth FROM orders),
ranked AS (SELECT *, {PRIORITY} AS priority, {host('url')} AS host FROM queue)"""


def queue(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 3 == 0, "big").otherwise(F.concat(F.lit("h"), (c % 40).cast("string")))
    url = F.concat(F.lit("https://"), name, F.lit(".example.org/p/"), k.cast("string"), F.when(k % 11 == 0, ".pdf").otherwise(""))
    rows = t("orders").select(k.alias("seq"), url.alias("url"), (c % 4).cast("int").alias("depth"))
    return rows.withColumn("priority", U.crawl_priority("url", F.col("depth")))


@query("frontier_add", f"""
WITH {QUEUE_SQL}, arrivals AS (SELECT regexp_replace(url, '/p/[0-9]+', '/p/' || (seq // 40)) AS url, priority, depth, seq FROM ranked),
first_seen AS (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)
SELECT url, priority::BIGINT AS priority, seq FROM ranked UNION ALL SELECT url, priority::BIGINT, seq FROM first_seen WHERE url NOT IN (SELECT url FROM ranked)""")
def _(t):
    waiting = queue(t)
    arrivals = waiting.withColumn(
        "url", F.regexp_replace(F.col("url"), F.lit("/p/[0-9]+"), F.concat(F.lit("/p/"), F.floor(F.col("seq") / 40).cast("string")))
    )
    added = frontier.add(waiting, waiting.select("url"), arrivals)
    return added.select("url", F.col("priority").cast("long"), "seq")


TURNS = f"""WITH {QUEUE_SQL}, served AS (SELECT 'h' || s_suppkey || '.example.org' AS host, s_suppkey % 7 AS n FROM supplier),
turns AS (SELECT r.*, coalesce(s.n, 0) + row_number() OVER (PARTITION BY r.host ORDER BY priority, depth, seq) - 1 AS turn FROM ranked r LEFT JOIN served s USING (host))"""


def served(t):
    s = F.col("s_suppkey")
    return t("supplier").select(
        F.concat(F.lit("h"), s.cast("string"), F.lit(".example.org")).alias("host"), (s % 7).alias("n")
    )


@query("frontier_fair_order", f"{TURNS} SELECT url, turn::BIGINT AS turn FROM turns")
def _(t):
    return frontier.fair_order(queue(t), served(t)).select("url", F.col("turn").cast("long"))


@query("frontier_pop", f"{TURNS} SELECT url, turn::BIGINT AS turn FROM turns ORDER BY turn, priority, depth, seq LIMIT 500")
def _(t):
    return frontier.pop(queue(t), 500, served(t)).select("url", F.col("turn").cast("long"))


@query("frontier_depth_cut", f"WITH {QUEUE_SQL} SELECT url FROM queue WHERE depth <= 2 OR url LIKE '%.pdf'")
def _(t):
    return frontier.within_depth(queue(t), 2).select("url")


@query("robots_sitemaps", f"""
SELECT DISTINCT {host('url')} AS host, 'https://' || {host('url')} || '/' || CASE page_id % 2 WHEN 0 THEN 'sitemap.xml' ELSE 'Harta.xml' END AS url FROM pages WHERE page_id % 5 <> 0""")
def _(t):
    h = U.host("url")
    name = F.when(F.col("page_id") % 2 == 0, "sitemap.xml#x").otherwise("Harta.xml")
    robots = t("pages").select(
        h.alias("host"), F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("status"),
        F.concat(F.lit("User-agent: *\r\nDisallow:\r\nSITEMAP:  https://"), F.upper(h), F.lit("//"), name, F.lit("\n# end")).alias("content"),
    )
    return frontier.robots_sitemaps(robots)


@query("usual_sitemaps", f"""
WITH h AS (SELECT {host('url')} AS host, bool_or(page_id % 2 = 0) AS named FROM pages GROUP BY 1)
SELECT host, 'https://' || host || p.path AS url FROM h, (SELECT unnest({words.SITEMAP_PATHS}) AS path) p
WHERE NOT (named AND p.path IN ('/sitemap_index.xml', '/sitemap-index.xml'))""")
def _(t):
    hosts = t("pages").select(U.host("url").alias("host")).distinct()
    named = t("pages").filter("page_id % 2 = 0").select(U.host("url").alias("host"))
    return frontier.usual_sitemaps(hosts, named)


# Every host's index names three maps, each of which names a part of the host's pages.
@query("sitemap_harvest", f"""
WITH p AS (SELECT {host('url')} AS host, {normal('url')} AS url FROM pages)
SELECT host, url FROM (SELECT DISTINCT host, url FROM p WHERE NOT regexp_matches(lower(url), 'sitemap|\\.xml$'))
QUALIFY row_number() OVER (PARTITION BY host ORDER BY url) <= 8000""")
def _(t):
    pages = t("pages").select(U.host("url").alias("host"), "url", (F.col("page_id") % 3).alias("part"))
    roots = pages.select("host", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url")).distinct()
    child = F.concat(F.lit("https://"), F.col("host"), F.lit("/harta-"), F.col("part").cast("string"), F.lit(".xml"))
    loc = lambda c: F.concat(F.lit("<url><loc> "), c, F.lit(" </loc></url>"))
    top = pages.select("host", child.alias("child")).distinct().groupBy("host").agg(
        F.array_join(F.collect_list(loc(F.col("child"))), "\n").alias("content")
    ).select(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"), "content")
    parts = pages.groupBy("host", "part").agg(F.array_join(F.collect_list(loc(F.col("url"))), "").alias("content")).select(
        child.alias("url"), "content"
    )
    stored = top.unionByName(parts).withColumn("status", F.lit(200))
    return frontier.harvest_sitemaps(roots, stored)


@query("crawl_traversal", """
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'o' || l_orderkey AS b FROM lineitem),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT 's1' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM reach JOIN both_ways ON a = node WHERE depth < 2)
SELECT 'https://x.example.org/' || node AS url, min(depth)::BIGINT AS depth FROM reach GROUP BY node""")
def _(t):
    """Suppliers and orders as pages that link to each other."""
    page = lambda kind, c: F.concat(F.lit(f"https://x.example.org/{kind}"), F.col(c).cast("string"))
    edges = t("lineitem").select(page("s", "l_suppkey").alias("a"), page("o", "l_orderkey").alias("b"))
    both = edges.select(F.col("a").alias("page_url"), F.col("b").alias("url")).unionByName(
        edges.select(F.col("b").alias("page_url"), F.col("a").alias("url"))
    )
    seeds = edges.sparkSession.createDataFrame([("https://x.example.org/s1",)], "url string")
    return frontier.crawl(both, seeds, 2).select("url", F.col("depth").cast("long"))




@query("crawl_job", """
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, CASE WHEN l_orderkey % 50 = 0 THEN 'cart/o' ELSE 'o' END || l_orderkey AS b, l_orderkey FROM lineitem),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e WHERE l_orderkey % 7 <> 0),
reach AS (SELECT 's1' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM reach JOIN both_ways ON a = node WHERE depth < 2 AND NOT contains(b, 'cart/'))
SELECT 'https://x.example.org/' || node AS url, min(depth)::BIGINT AS depth, node LIKE 'o%' AND substr(node, 2)::BIGINT % 7 = 0 AS missing FROM reach GROUP BY node""")
def _(t):
    """The same graph with pages that cannot be fetched and addresses that are not worth a visit; the budget reaches for all."""
    order = F.concat(F.when(F.col("l_orderkey") % 50 == 0, "cart/o").otherwise("o"), F.col("l_orderkey").cast("string"))
    page = lambda name: F.concat(F.lit("https://x.example.org/"), name)
    edges = t("lineitem").select(page(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("a"), page(order).alias("b"), (F.col("l_orderkey") % 7 == 0).alias("gone"))
    links = edges.select(F.col("a").alias("page_url"), F.col("b").alias("url")).unionByName(edges.select(F.col("b").alias("page_url"), F.col("a").alias("url"))).distinct()
    pages = edges.select(F.col("a").alias("url"), F.lit(200).alias("status")).unionByName(
        edges.select(F.col("b").alias("url"), F.when(F.col("gone"), 404).otherwise(200).alias("status"))
    ).distinct()
    one = lambda value, name: t.spark.createDataFrame([(value,)], f"{name} string")
    found = crawl.crawl_job(pages, links, one("https://x.example.org/s1", "url"), one("x.example.org", "host"), max_pages=10_000_000, max_depth=2, batch=20_000)
    return found.select("url", F.col("depth").cast("long"), (F.col("status") >= 400).alias("missing"))
