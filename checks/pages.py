"""Page extraction, clean-up and classification over the pages and documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.registry import query
from checks.sqlre import like, sql_text
from checks.text import quoted
from quaero.functions import urls as U
from quaero.operators import cleaning, evidence, html, links
from quaero.plans import index
from quaero.sources import tables
from quaero.values import patterns, words

NORMAL = r"""
regexp_replace({u}, '^([a-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?.*$', '\1://') || lower(regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1))
 || regexp_replace(CASE WHEN regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1) END, '/{{2,}}', '/', 'g')
 || regexp_extract({u}, '^[^?#]*(\?[^#]+)', 1)"""


def normal(u: str) -> str:
    return "(" + NORMAL.format(u=u).strip() + ")"


HOST = "regexp_replace(lower(regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '')"


def host(u: str) -> str:
    return HOST.format(u=u)


# Pages with some addresses turned into documents, assets and endpoints.
VARIED_SQL = r"""
varied AS (SELECT page_id, CASE page_id % 6
   WHEN 0 THEN regexp_replace(url, '[?#].*$', '') || '/Raport-2024.PDF' WHEN 1 THEN regexp_replace(url, '[?#].*$', '') || '/img/logo.png'
   WHEN 2 THEN regexp_replace(url, '[?#].*$', '') || '//anunt/concurs?page=' || page_id WHEN 3 THEN regexp_replace(url, '[?#].*$', '') || '/wp-login.php'
   ELSE url END AS url, page_id % 5 AS depth FROM pages)"""


def varied(t):
    bare = F.regexp_replace("url", "[?#].*$", "")
    kind = F.col("page_id") % 6
    url = (
        F.when(kind == 0, F.concat(bare, F.lit("/Raport-2024.PDF")))
        .when(kind == 1, F.concat(bare, F.lit("/img/logo.png")))
        .when(kind == 2, F.concat(bare, F.lit("//anunt/concurs?page="), F.col("page_id").cast("string")))
        .when(kind == 3, F.concat(bare, F.lit("/wp-login.php"))).otherwise(F.col("url"))
    )
    return t("pages").select("page_id", url.alias("url"), (F.col("page_id") % 5).alias("depth"))


@query("url_normalize", f"WITH {VARIED_SQL} SELECT page_id, {normal('url')} AS url_norm FROM varied")
def _(t):
    return varied(t).select("page_id", U.normalize_url("url").alias("url_norm"))


PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
EXTENSIONS = "|".join(re.escape(e) for e in words.DOCUMENT_EXTENSIONS)
SKIPPED = "|".join(re.escape(e) for e in words.SKIPPED_PATH_PARTS)


@query("url_parts", f"""
WITH {VARIED_SQL}, c AS (SELECT *, {host('url')} AS h, substr(replace(trim({PATH}, '/'), '/', '-'), 1, 40) AS p FROM varied)
SELECT page_id, h AS host, substr(lower(trim(regexp_replace(replace(h, '.', '-') || CASE WHEN p = '' THEN '' ELSE '-' || p END, '[^a-zA-Z0-9_-]+', '-', 'g'), '-')), 1, 64) AS code,
  regexp_matches(lower({PATH}), '({EXTENSIONS})$') AS is_document,
  NOT regexp_matches(lower({PATH}), '{SKIPPED}') AS crawlable FROM c""")
def _(t):
    return varied(t).select(
        "page_id", U.host("url").alias("host"), U.source_code("url").alias("code"),
        U.is_document("url").alias("is_document"), U.is_crawlable("url").alias("crawlable"),
    )


@query("url_priority", f"""
WITH {VARIED_SQL}
SELECT page_id, CASE WHEN regexp_matches(lower({PATH}), '({EXTENSIONS})$') THEN depth - 20 ELSE 40 + depth * 8
  - CASE WHEN regexp_matches(lower(url), '{"|".join(words.PRIORITY_WORDS)}') THEN 20 ELSE 0 END
  - CASE WHEN regexp_matches(lower(url), '{"|".join(words.ANNOUNCEMENT_WORDS)}') THEN 15 ELSE 0 END
  - CASE WHEN len(rtrim(url, '/')) - len(replace(rtrim(url, '/'), '/', '')) <= 3 THEN 5 ELSE 0 END END::BIGINT AS priority FROM varied""")
def _(t):
    return varied(t).select("page_id", U.crawl_priority("url", F.col("depth")).cast("long").alias("priority"))


@query("pagination_hints", f"""
WITH {VARIED_SQL}, a AS (SELECT v.page_id, v.url, regexp_extract(html, '<a href="[^"]*">([^<]*)</a>', 1) AS anchor FROM varied v JOIN pages p USING (page_id))
SELECT page_id, {like('anchor', patterns.PAGING_ANCHOR)} OR regexp_matches(lower(url || ' ' || anchor), '{patterns.PAGING_URL}') AS hint FROM a""")
def _(t):
    anchors = t("pages").select("page_id", F.regexp_extract("html", '<a href="[^"]*">([^<]*)</a>', 1).alias("anchor"))
    return varied(t).join(anchors, "page_id").select("page_id", U.is_pagination_hint("url", "anchor").alias("hint"))


def page_rows(t):
    return t("pages").select("page_id", U.normalize_url("url").alias("url"), "html")


# The given pages hold links in their menu only, each with a path and a plain text.
LINKS_SQL = f"""
raw AS (SELECT page_id, {normal('url')} AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
   unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor FROM pages),
full_links AS (SELECT page_id, page_url, anchor, CASE WHEN href LIKE '/%' THEN regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1) || href ELSE href END AS url FROM raw),
links AS (SELECT DISTINCT page_id, page_url, url FROM full_links)"""


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, url FROM links")
def _(t):
    return html.link_table(html.extract_pages(page_rows(t))).select("page_id", "url")


@query("page_link_order", f"""
WITH {LINKS_SQL} SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY url)::BIGINT AS link_pos FROM links""")
def _(t):
    return html.link_table(html.extract_pages(page_rows(t))).select("page_id", "url", F.col("link_pos").cast("long"))


ENTITY = "replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("page_titles", f"""
SELECT page_id, trim({ENTITY.format(c="regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) AS title FROM pages""")
def _(t):
    return html.extract_pages(page_rows(t)).select("page_id", "title")


@query("page_main_text")
def _(t):
    return html.extract_pages(page_rows(t)).select(
        "page_id", F.length("content").alias("chars"), F.md5("content").alias("content"),
        F.size("links").alias("links"), F.size("assets").alias("assets"),
    )


@query("page_chrome_removed", "SELECT page_id, true AS clean FROM pages")
def _(t):
    """No menu, script, style or footer text is left in the main text."""
    texts = html.extract_pages(page_rows(t))
    return texts.select("page_id", (~F.col("content").rlike("track\\(|margin:0|©")).alias("clean"))


@query("asset_references")
def _(t):
    """References of each page next to those inside its own scripts and styles."""
    found = html.extract_pages(page_rows(t)).select("page_id", F.size("assets").alias("assets"))
    return found.groupBy("assets").agg(F.count("*").alias("pages"))


ASSET_TRIM = "rtrim(rtrim(trim({c}), chr(92)), '.,);]')"


@query("urls_in_scripts", rf"""
WITH src AS (SELECT page_id, {normal('url')} AS page_url, html FROM pages),
refs AS (SELECT page_id, page_url, unnest(list_concat(list_concat(
   regexp_extract_all(html, '(?i)(?:^|[^\w./-])(https?://[^\s"''<>\\)]+)', 1), regexp_extract_all(html, '(?i)url\(\s*[''"]?([^)''"\s]+)[''"]?\s*\)', 1)), list_concat(
   regexp_extract_all(html, '[''"](/[a-zA-Z0-9][^''"]{{2,240}})[''"]', 1),
   regexp_extract_all(html, '(?i)(?:href|src|url|path|link|permalink|endpoint)\s*[:=]\s*[''"]([^''"]+)[''"]', 1)))) AS ref FROM src),
trimmed AS (SELECT page_id, page_url, {ASSET_TRIM.format(c='ref')} AS ref FROM refs),
made AS (SELECT page_id, CASE WHEN ref LIKE '/%' THEN regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1) || ref ELSE ref END AS url FROM trimmed
  WHERE ref <> '' AND ref NOT LIKE '#%' AND NOT regexp_matches(lower(ref), '({"|".join(re.escape(e) for e in words.ASSET_EXTENSIONS)})$'))
SELECT DISTINCT page_id, {normal('url')} AS url FROM made""")
def _(t):
    return links.urls_in_assets(page_rows(t), ["page_id"], text="html").select("page_id", "url")


@query("links_from_assets")
def _(t):
    """Every page names the pages before it as its scripts; what those hold becomes its links."""
    pages = page_rows(t)
    bodies = pages.select(F.col("url").alias("asset_url"), F.lit(200).alias("status"), F.col("html").alias("content"))
    named = pages.groupBy((F.floor(F.col("page_id") / 8)).alias("page_id")).agg(
        F.min("url").alias("url"), F.sort_array(F.collect_list("url")).alias("assets")
    )
    found = links.links_from_assets(named, bodies)
    return found.groupBy("page_id", "anchor").agg(F.count("*").alias("links"))



@query("keyword_relevance", f"""
WITH {LINKS_SQL}, pairs AS (SELECT DISTINCT url, anchor FROM full_links),
stems AS (SELECT DISTINCT lower(w) AS s FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}]{{9,}}')) AS w FROM benchmark)),
keys AS (SELECT s AS k FROM stems UNION SELECT substr(s, 1, len(s) - 1) FROM stems WHERE regexp_matches(s, '[aăei]$') AND len(s) > 4
  UNION SELECT lower(r_name) || j || lang FROM region, (VALUES ('-'), ('_'), ('/')) AS v(j), (SELECT DISTINCT lang FROM documents) AS l),
hits AS (SELECT DISTINCT url, anchor, k FROM pairs, keys WHERE contains(lower(url || ' ' || anchor), k))
SELECT p.url, p.anchor, count(k)::BIGINT AS hits, count(k) > 0 AS relevant FROM pairs p LEFT JOIN hits USING (url, anchor) GROUP BY ALL""")
def _(t):
    stems = t("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]{9,}"), F.lit(0))).alias("w"))
    stems = stems.select(F.lower("w").alias("stem")).distinct().withColumn("at", F.crc32("stem"))
    names = [r[0].lower() for r in t("region").select("r_name").collect()]
    langs = [r[0] for r in t("documents").select("lang").distinct().collect()]
    keywords = links.keyword_table(stems.sparkSession, stems, names, langs)
    extracted = html.extract_pages(page_rows(t))
    rows = extracted.select(F.explode("links").alias("l")).select(U.normalize_url("l.url").alias("url"), F.col("l.anchor").alias("anchor"))
    found = links.keyword_hits(rows, keywords, limit=1_000)
    return found.select("url", "anchor", F.size("hits").cast("long").alias("hits"), "relevant")


# --- fetched pages -----------------------------------------------------------------------

FETCHED_SQL = f"""
fetched AS (SELECT page_id, url, html, CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS status,
  CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/vnd.ms-excel' WHEN 2 THEN 'application/octet-stream' ELSE 'text/html; charset=utf-8' END AS content_type FROM pages),
kinds AS (SELECT *, CASE WHEN regexp_matches(lower({PATH}), '\\.(html|htm|php|aspx)$') AND regexp_matches(lower(substr(html, 1, 200)), '^\\s*<!doctype|<html') OR content_type LIKE 'text/html%' THEN 'html'
   WHEN content_type LIKE '%pdf%' THEN 'pdf' WHEN content_type LIKE '%excel%' THEN 'xls' WHEN contains(lower(substr(html, 1, 2000)), '<html') THEN 'html' ELSE 'skip' END AS kind FROM fetched)"""


def fetched(t):
    kind, code = F.col("page_id") % 5, F.col("page_id") % 7
    return tables.fetched_pages(
        t("pages"),
        F.when(code == 0, 404).when(code == 1, 500).otherwise(200),
        F.when(kind == 0, "application/pdf").when(kind == 1, "application/vnd.ms-excel")
        .when(kind == 2, "application/octet-stream").otherwise("text/html; charset=utf-8"),
    )


def kind_of():
    return cleaning.content_kind(F.col("content_type"), F.col("final_url"), F.col("html"))


@query("content_kinds", f"WITH {FETCHED_SQL} SELECT page_id, kind, status >= 400 AS failed FROM kinds")
def _(t):
    return fetched(t).select("page_id", kind_of().alias("kind"), cleaning.is_http_error(F.col("status")).alias("failed"))


@query("crawl_counters", f"""
WITH {FETCHED_SQL} SELECT kind, CASE WHEN status >= 400 THEN 'error' ELSE 'fetched' END AS outcome, count(*)::BIGINT AS n FROM kinds GROUP BY ALL""")
def _(t):
    return links.crawl_counters(fetched(t), kind_of(), F.when(F.col("status") >= 400, "error").otherwise("fetched"))


@query("fetched_extraction", f"WITH {FETCHED_SQL} SELECT page_id, {normal('url')} AS url FROM kinds WHERE status < 400 AND kind = 'html'")
def _(t):
    return index.extract(fetched(t)).select("page_id", "url")


# --- clean-up of texts -------------------------------------------------------------------

# Documents with widget lines, menu lines and endings put between their own lines.
NOISY_SQL = r"""
noisy AS (SELECT doc_id, replace(text, E'\n', CASE doc_id % 4 WHEN 0 THEN E'\n\n\n\nDownload\n12 KB\n' WHEN 1 THEN E'\n  Pretura \n123\nORGANELE DE DREPT\n' WHEN 2 THEN E'\n[expire_date]\t\t x\nShare:\n' ELSE E'\n' END)
  || CASE doc_id % 5 WHEN 0 THEN E'\nComentarii\nmulte' WHEN 1 THEN E'\nVEZI TOATE\nmulte' WHEN 2 THEN E'\nTags:\na\nComments\nb' ELSE '' END AS body FROM documents)"""


def noisy(t):
    kind, tail = F.col("doc_id") % 4, F.col("doc_id") % 5
    between = (
        F.when(kind == 0, "\n\n\n\nDownload\n12 KB\n").when(kind == 1, "\n  Pretura \n123\nORGANELE DE DREPT\n")
        .when(kind == 2, "\n[expire_date]\t\t x\nShare:\n").otherwise("\n")
    )
    end = F.when(tail == 0, "\nComentarii\nmulte").when(tail == 1, "\nVEZI TOATE\nmulte").when(
        tail == 2, "\nTags:\na\nComments\nb").otherwise("")
    return t("documents").select("doc_id", F.concat(F.replace("text", F.lit("\n"), between), end).alias("body"))


def cut_sql(c: str) -> str:
    """The text before its first end line; a late one counts from the 81st character on."""
    early = "|".join(re.escape(m) for m in patterns.EARLY_END_LINES)
    firsts = [f"strpos({c}, regexp_extract({c}, '(?i)\\n(?:{early})\\n'))"]
    guards = [f"regexp_extract({c}, '(?i)\\n(?:{early})\\n') <> ''"]
    for m in patterns.LATE_END_LINES:
        one = f"regexp_extract({c}, '(?i)\\n{re.escape(m)}\\n')"
        firsts.append(f"strpos({c}, {one})")
        guards.append(f"{one} <> '' AND strpos({c}, {one}) - 1 > 80")
    places = ", ".join(f"CASE WHEN {g} THEN {f} END" for f, g in zip(firsts, guards))
    return f"trim(CASE WHEN least({places}) IS NOT NULL THEN substr({c}, 1, least({places}) - 1) ELSE {c} END, E' \\t\\n\\r')"


def kept_lines(c: str, drop: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split({c}, E'\\n'), lambda s: trim(s, E' \\t\\r')), "
        f"lambda s: s = '' OR NOT ({drop})), E'\\n')"
    )


NORMALIZE_DROP = " OR ".join(
    f"regexp_matches(s, '(?i){sql_text(p)}')"
    for p in (patterns.READ_MORE_LINE, patterns.SHARE_LINE, patterns.DOWNLOAD_LINE, patterns.FILE_SIZE_LINE)
)
MENU = patterns.MENU_LINE.replace(r"\w", r"[\p{L}\p{N}_]")
SCRUB_DROP = (
    f"(len(s) <= 42 AND regexp_matches(s, '(?i){sql_text(MENU)}')) OR (len(s) < 120 AND regexp_matches(s, '(?i){sql_text(patterns.MENU_BLOB)}')) "
    f"OR regexp_matches(s, '{patterns.NUMBER_LINE}')"
)


def normalized_sql() -> str:
    text = "regexp_replace(regexp_replace(body, '[ \\t]+', ' ', 'g'), '\\n{3,}', E'\\n\\n', 'g')"
    for p in patterns.PLACEHOLDERS:
        text = f"regexp_replace({text}, '(?i){p}', '', 'g')"
    return f"trim({kept_lines(text, NORMALIZE_DROP)}, E' \\t\\n\\r')"


@query("page_text_normalize", f"""
WITH {NOISY_SQL}, n AS (SELECT doc_id, {normalized_sql()} AS x FROM noisy)
SELECT doc_id, len({cut_sql('x')})::BIGINT AS chars, md5({cut_sql('x')}) AS content FROM n""")
def _(t):
    found = noisy(t).select("doc_id", cleaning.normalize_page_text("body").alias("x"))
    return found.select("doc_id", F.length("x").cast("long").alias("chars"), F.md5("x").alias("content"))


@query("page_text_cut", f"WITH {NOISY_SQL} SELECT doc_id, md5({cut_sql('body')}) AS content FROM noisy")
def _(t):
    return noisy(t).select("doc_id", F.md5(cleaning.cut_after_end("body")).alias("content"))


@query("page_text_scrub", f"""
WITH {NOISY_SQL}, n AS (SELECT doc_id, {kept_lines('body', SCRUB_DROP)} AS x FROM noisy), c AS (SELECT doc_id, {cut_sql('x')} AS y FROM n)
SELECT doc_id, md5(trim(regexp_replace(y, '\\n{{3,}}', E'\\n\\n', 'g'), E' \\t\\n\\r')) AS content FROM c""")
def _(t):
    return noisy(t).select("doc_id", F.md5(cleaning.scrub("body")).alias("content"))


DEAD = sql_text(patterns.DEAD_PAGE)
DEAD_SQL = r"""
titled AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '404' WHEN 1 THEN 'Pagina nu a fost găsită' WHEN 2 THEN 'Eroare' WHEN 3 THEN 'Oops! nothing was found' WHEN 4 THEN 'Page not found here' ELSE split_part(text, E'\n', 1) END AS title,
  CASE doc_id % 10 WHEN 0 THEN 'not found. ' || text ELSE text END AS body, CASE WHEN doc_id % 50 = 0 THEN 410 ELSE 200 END AS status FROM documents)"""


def titled(t):
    kind = F.col("doc_id") % 6
    title = (
        F.when(kind == 0, "404").when(kind == 1, "Pagina nu a fost găsită").when(kind == 2, "Eroare")
        .when(kind == 3, "Oops! nothing was found").when(kind == 4, "Page not found here")
        .otherwise(F.split("text", "\n")[0])
    )
    body = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("not found. "), "text")).otherwise(F.col("text"))
    status = F.when(F.col("doc_id") % 50 == 0, 410).otherwise(200)
    return t("documents").select("doc_id", title.alias("title"), body.alias("body"), status.alias("status"))


@query("soft_404", f"""
WITH {DEAD_SQL}, h AS (SELECT *, len(regexp_extract_all(title || E'\\n' || substr(body, 1, 2500), '(?i){DEAD}')) AS hits,
   len(trim(body, E' \\t\\n\\r')) AS size, lower(trim(title)) AS low FROM titled)
SELECT doc_id, status >= 400 OR low IN ({quoted(words.DEAD_TITLES)}) OR low LIKE '404%'
  OR (hits > 0 AND (hits >= 2 OR size < 400 OR contains(low, 'not found') OR (size < 800 AND regexp_matches(title, '(?i){DEAD}')))) AS dead FROM h""")
def _(t):
    return titled(t).select("doc_id", cleaning.is_soft_404(F.col("status"), F.col("title"), F.col("body")).alias("dead"))


@query("polluted_documents", r"""
WITH d AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'Dispozițiile Pretorului x' WHEN 1 THEN 'vezi Căutați pe Internet' ELSE '' END || text AS content,
  CASE doc_id % 8 WHEN 0 THEN 'Cariera mea' ELSE 'alt titlu' END AS title, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' ELSE 'text/html' END AS mime FROM documents)
SELECT doc_id AS document_id FROM d WHERE mime = 'text/html' AND (content ILIKE '%DISPOZI%PRETORULUI%' OR content ILIKE '%Căutați pe Internet%' OR content ILIKE '%Cautati pe Internet%' OR title ILIKE '%cariera%')""")
def _(t):
    i = F.col("doc_id")
    lead = F.when(i % 9 == 0, "Dispozițiile Pretorului x").when(i % 9 == 1, "vezi Căutați pe Internet").otherwise("")
    rows = t("documents").select(
        i.alias("document_id"), F.concat(lead, "text").alias("content"),
        F.when(i % 8 == 0, "Cariera mea").otherwise("alt titlu").alias("title"),
        F.when(i % 5 == 0, "application/pdf").otherwise("text/html").alias("mime_type"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/")).alias("url"),
    )
    return cleaning.polluted_documents(rows, limit=None).select("document_id")


def types_sql(blob: str) -> str:
    ladder = "".join(
        f" WHEN {' OR '.join(f'contains({blob}, {chr(39)}{n}{chr(39)})' for n in needles)} THEN '{name}'"
        for name, needles in patterns.DOCUMENT_TYPES
    )
    return f"CASE{ladder} ELSE '{patterns.DOCUMENT_TYPE_DEFAULT}' END"


@query("document_types", f"""
WITH d AS (SELECT doc_id, lower(split_part(text, E'\\n', 1) || ' https://' || source || '.example.org/' || CASE doc_id % 8 WHEN 0 THEN 'Contact' WHEN 1 THEN 'decizie' WHEN 2 THEN 'regulament' WHEN 3 THEN 'anunt' WHEN 4 THEN 'x.pdf' ELSE lang END || ' ' || substr(text, 1, 200)) AS blob FROM documents)
SELECT doc_id, {types_sql('blob')} AS kind FROM d""")
def _(t):
    i = F.col("doc_id") % 8
    tail = F.when(i == 0, "Contact").when(i == 1, "decizie").when(i == 2, "regulament").when(i == 3, "anunt").when(
        i == 4, "x.pdf").otherwise(F.col("lang"))
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), tail)
    return t("documents").select(
        "doc_id", evidence.document_type(F.split("text", "\n")[0], url, F.col("text")).alias("kind")
    )
