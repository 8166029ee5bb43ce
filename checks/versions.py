"""Change detection, upserts, deletes and duplicates over the documents."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from checks.pages import normal
from checks.registry import query
from quaero.functions import text as T
from quaero.functions import urls as U
from quaero.operators import versioning
from quaero.operators.keyed import first_rows
from quaero.plans.store import CorpusStore
from quaero.session import shared_folder
from quaero.sources.merge_table import MergeTable
from quaero.sources.tables import fetched_pages

HASH = r"sha256(regexp_replace(trim({c}, E' \t\n\r'), '\s+', ' ', 'g'))"
# What is stored, and what arrives: some texts changed, some gone, some new.
STATE_SQL = f"""
stored AS (SELECT doc_id AS document_id, 'https://' || source || '.example.org/' || doc_id AS url, text AS content, {HASH.format(c='text')} AS content_hash FROM documents WHERE doc_id % 7 <> 0),
arrived AS (SELECT 'https://' || source || '.example.org/' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN text || ' plus' ELSE text END AS content FROM documents WHERE doc_id % 5 <> 0),
arrivals AS (SELECT *, {HASH.format(c='content')} AS content_hash FROM arrived),
status AS (SELECT coalesce(s.url, a.url) AS url, s.document_id, s.content_hash AS old_hash, a.content_hash AS new_hash,
  CASE WHEN a.url IS NULL THEN 'kept' WHEN s.url IS NULL THEN 'new' WHEN s.content_hash = a.content_hash THEN 'unchanged' ELSE 'updated' END AS status
  FROM stored s FULL JOIN arrivals a USING (url))"""


def address():
    return F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string"))


def stored(t):
    rows = t("documents").filter("doc_id % 7 != 0")
    return rows.select(
        F.col("doc_id").alias("document_id"), address().alias("url"), F.lit("t").alias("title"),
        F.col("text").alias("content"), T.content_hash("text").alias("content_hash"), F.lit("text/html").alias("mime_type"),
    )


def arrivals(t):
    rows = t("documents").filter("doc_id % 5 != 0")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" plus"))).otherwise(F.col("text"))
    return rows.select(
        address().alias("url"), F.lit("t2").alias("title"), content.alias("content"), F.lit("text/html").alias("mime_type")
    ).withColumn("content_hash", T.content_hash("content"))


def status(t):
    return versioning.upsert_status(stored(t), arrivals(t))


@query("upsert_status", f"WITH {STATE_SQL} SELECT url, status, document_id, old_hash, new_hash FROM status")
def _(t):
    return status(t)


@query("upsert_documents", f"""
WITH {STATE_SQL} SELECT s.url, s.document_id, coalesce(CASE WHEN s.status IN ('new', 'updated') THEN a.content_hash END, s.old_hash) AS content_hash,
  CASE WHEN s.status IN ('new', 'updated') THEN 't2' ELSE 't' END AS title FROM status s LEFT JOIN arrivals a USING (url)""")
def _(t):
    return versioning.upsert(stored(t), arrivals(t)).select("url", "document_id", "content_hash", "title")


@query("change_log", f"WITH {STATE_SQL} SELECT document_id, old_hash, new_hash, 'Content changed for ' || url AS note FROM status WHERE status = 'updated'")
def _(t):
    log = versioning.change_log(status(t), F.lit("2026-01-01").cast("timestamp"))
    return log.select("document_id", "old_hash", "new_hash", "note")


@query("change_lines", r"""
SELECT doc_id, len(list_distinct(list_filter(string_split(text, E'\n'), lambda s: s <> '')))::BIGINT AS lines,
  (CASE WHEN list_contains(string_split(text, E'\n'), 'nou') THEN 0 ELSE 1 END)::BIGINT AS added, 0::BIGINT AS removed FROM documents""")
def _(t):
    changed = versioning.line_changes(F.col("text"), F.concat("text", F.lit("\nnou")))
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda s: s != ""))
    return t("documents").select("doc_id", lines.alias("l"), changed.alias("c")).select(
        "doc_id", F.size("l").cast("long").alias("lines"), F.size("c.added").cast("long").alias("added"),
        F.size("c.removed").cast("long").alias("removed"),
    )


@query("arrivals_prepared", r"""
WITH f AS (SELECT doc_id, source || '/' || (doc_id // 3) AS url, trim(substr(text, 1, CASE WHEN doc_id % 10 = 0 THEN 30 ELSE 100000 END), E' \t\n\r') AS content FROM documents)
SELECT url, max(doc_id)::BIGINT AS seq FROM f WHERE len(content) >= 40 GROUP BY url""")
def _(t):
    """Text as it is kept is at least 40 characters long; every tenth is cut shorter."""
    body = F.when(F.col("doc_id") % 10 == 0, F.substring("text", 1, 30)).otherwise(F.col("text"))
    fetched = t("documents").select(
        F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 3).cast("string")).alias("url"),
        F.lit("t").alias("title"), body.alias("content"), F.col("doc_id").alias("seq"),
    )
    return versioning.prepare(fetched).select("url", "seq")


@query("dead_documents", f"""
WITH {STATE_SQL}, dead AS (SELECT DISTINCT url FROM stored WHERE document_id % 11 = 0 OR content ILIKE '%tion the%')
SELECT document_id, url FROM stored WHERE url NOT IN (SELECT url FROM dead)""")
def _(t):
    docs = stored(t)
    fetched = docs.select("url", "content", F.when(F.col("document_id") % 11 == 0, 404).otherwise(200).alias("status"))
    dead = versioning.dead_urls(fetched, F.col("content").ilike("%tion the%"))
    return versioning.delete(docs, dead)[0].select("document_id", "url")


def line_chunks(docs):
    return docs.select(
        "document_id", F.posexplode(F.split("content", "\n")).alias("no", "content")
    ).select("document_id", (F.col("document_id") * 100_000 + F.col("no")).alias("chunk_id"), "content")


LINES = r"SELECT document_id, document_id * 100000 + unnest(range(0, len(string_split(content, E'\n')))) AS chunk_id FROM {src}"


@query("dead_chunks", f"""
WITH {STATE_SQL}, dead AS (SELECT url FROM stored WHERE document_id % 11 = 0), c AS ({LINES.format(src='stored')})
SELECT document_id, count(*)::BIGINT AS chunks FROM c WHERE document_id % 11 <> 0 GROUP BY document_id""")
def _(t):
    docs = stored(t)
    dead = docs.filter("document_id % 11 = 0").select("url")
    return versioning.delete(docs, dead, line_chunks(docs))[1].groupBy("document_id").agg(F.count("*").alias("chunks"))


@query("replaced_chunks", f"""
WITH {STATE_SQL}, fresh AS (SELECT s.document_id, a.content FROM status s JOIN arrivals a USING (url) WHERE s.status = 'updated'),
old AS ({LINES.format(src='stored')}), new AS ({LINES.format(src='fresh')})
SELECT document_id, chunk_id FROM old WHERE document_id NOT IN (SELECT document_id FROM fresh) UNION ALL SELECT document_id, chunk_id FROM new""")
def _(t):
    st = status(t)
    docs = versioning.upsert(stored(t), arrivals(t)).join(st.filter("status = 'updated'").select("url"), "url", "left_semi")
    return versioning.replace_chunks(line_chunks(stored(t)), st, line_chunks(docs)).select("document_id", "chunk_id")


@query("duplicate_groups", f"""
WITH h AS (SELECT doc_id, {HASH.format(c='text')} AS content_hash FROM documents)
SELECT content_hash, count(*)::BIGINT AS n, min(doc_id) AS keeper FROM h GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    docs = t("documents").select(F.col("doc_id").alias("document_id"), T.content_hash("text").alias("content_hash"))
    return versioning.duplicate_groups(docs)


@query("duplicates_removed", f"""
WITH h AS (SELECT doc_id, source, {HASH.format(c='text')} AS content_hash FROM documents)
SELECT min(doc_id) AS document_id, arg_min(source, doc_id) AS source, content_hash FROM h GROUP BY content_hash""")
def _(t):
    docs = t("documents").select(
        F.col("doc_id").alias("document_id"), "source", T.content_hash("text").alias("content_hash")
    )
    return versioning.keep_first_copies(docs)


def merged_table(t, *segments):
    """The stored rows as first segment, the arrivals as second one."""
    table = MergeTable(
        t.spark, f"{shared_folder(t.spark).rstrip('/')}/merge-table-{uuid.uuid4().hex}",
        "document_id long, url string, title string, content string, content_hash string, mime_type string", "url", ["document_id", "content_hash"], parts=8,
    )
    for rows, removed in segments:
        table.apply(rows, removed)
    return table


def changed_rows(t):
    """New and updated documents, and the addresses that die."""
    st = status(t).filter("status IN ('new', 'updated')").select("url", "document_id")
    rows = arrivals(t).join(st, "url")
    dead = stored(t).filter("document_id % 11 = 0").select("url").join(rows.select("url"), "url", "left_anti")
    return rows, dead


MERGED_SQL = f"""
WITH {STATE_SQL}, dead AS (SELECT url FROM status WHERE document_id % 11 = 0 AND status <> 'updated')
SELECT s.url, s.document_id, coalesce(CASE WHEN s.status IN ('new', 'updated') THEN a.content_hash END, s.old_hash) AS content_hash,
  CASE WHEN s.status IN ('new', 'updated') THEN 't2' ELSE 't' END AS title FROM status s LEFT JOIN arrivals a USING (url) WHERE s.url NOT IN (SELECT url FROM dead)"""


@query("merged_documents", MERGED_SQL)
def _(t):
    """Rows are merged when they are read; the second segment holds what changed and nothing else."""
    table = merged_table(t, (stored(t), None), changed_rows(t))
    return table.current().select("url", "document_id", "content_hash", "title")


@query("merged_keys", MERGED_SQL.replace(", CASE WHEN s.status IN ('new', 'updated') THEN 't2' ELSE 't' END AS title", "").replace(",\n  CASE WHEN s.status IN ('new', 'updated') THEN 't2' ELSE 't' END AS title", ""))
def _(t):
    """The narrow log alone, after parts with dead rows have been rewritten."""
    table = merged_table(t, (stored(t), None), changed_rows(t))
    table.compact(0.1)
    return table.keys().select("url", "document_id", "content_hash")


@query("change_hunks", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, unnest(range(1, len(string_split(text, E'\n')) + 1)) AS no FROM documents),
n AS (SELECT doc_id, no * 2 AS place, CASE WHEN no % 7 = 3 THEN line || ' nou' ELSE line END AS line FROM l WHERE no % 5 <> 0 UNION ALL SELECT doc_id, no * 2 + 1, 'linie ' || no FROM l WHERE no % 4 = 1),
made AS (SELECT doc_id, string_agg(line, E'\n' ORDER BY place) AS text, count(*)::BIGINT AS lines FROM n GROUP BY 1), c AS (SELECT doc_id, count(*)::BIGINT AS lines FROM l GROUP BY 1)
SELECT doc_id, md5(made.text) AS made, made.lines - c.lines AS more FROM made JOIN c USING (doc_id)""")
def _(t):
    """Texts with lines left out, changed and put in; the ordered hunks turn the old text into the new one."""
    lines = t("documents").select("doc_id", "text", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("no", F.col("at") + 1)
    changed = F.when(F.col("no") % 7 == 3, F.concat("line", F.lit(" nou"))).otherwise(F.col("line"))
    kept = lines.filter("no % 5 != 0").select("doc_id", (F.col("no") * 2).alias("at"), changed.alias("line"))
    more = lines.filter("no % 4 = 1").select("doc_id", (F.col("no") * 2 + 1).alias("at"), F.concat(F.lit("linie "), F.col("no").cast("string")).alias("line"))
    new = kept.unionByName(more).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "line")))["line"], "\n").alias("new"))
    both = t("documents").select("doc_id", "text").join(new, "doc_id").withColumn("hunks", versioning.line_hunks(F.col("text"), F.col("new")))
    grown = F.aggregate("hunks", F.lit(0), lambda n, h: n + F.size(h["added"]) - F.size(h["removed"]))
    return both.select("doc_id", F.md5(versioning.apply_hunks(F.col("text"), F.col("hunks"))).alias("made"), grown.cast("long").alias("more"))


def corpus_store(t):
    return CorpusStore(t.spark, f"{shared_folder(t.spark).rstrip('/')}/corpus-{uuid.uuid4().hex}")


AT = datetime.datetime(2026, 1, 1)


@query("manual_documents", r"""
WITH m AS (SELECT doc_id, trim(split_part(text, E'\n', 1), E' \t\n\r') AS title, CASE WHEN doc_id % 3 = 0 THEN 'https://' || source || '.example.org/' || (doc_id // 2) ELSE '' END AS url, trim(text, E' \t\n\r') AS text FROM documents),
u AS (SELECT doc_id, CASE WHEN url <> '' THEN url ELSE 'manual://admin/' || substr(title, 1, 80) END AS url, title FROM m WHERE len(text) >= 40)
SELECT url, substr(arg_max(title, doc_id), 1, 512) AS title, 'text/plain' AS mime_type, 'new' AS status FROM u GROUP BY url""")
def _(t):
    """Texts handed in twice: the second time nothing changes."""
    i = F.col("doc_id")
    texts = t("documents").select(
        F.split("text", "\n")[0].alias("title"), "text", i.alias("seq"),
        F.when(i % 3 == 0, F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.floor(i / 2).cast("string"))).alias("url"),
    )
    store = corpus_store(t)
    status = store.add_manual(texts, AT)
    again = store.add_manual(texts, AT).filter("status != 'unchanged'")
    now = store.documents.current().select("url", "title", "mime_type")
    return now.join(status.select("url", "status"), "url").join(again.select("url"), "url", "left_anti")


@query("refreshed_documents", f"""
WITH p AS (SELECT page_id, {normal('url')} AS url FROM pages), one AS (SELECT url, max(page_id) AS page_id FROM p GROUP BY url)
SELECT url, CASE WHEN page_id % 3 = 0 THEN 'updated' ELSE 'kept' END AS status, (page_id % 3 = 0)::BIGINT AS changes FROM one""")
def _(t):
    """Pages as stored long ago, every third under a menu's title, extracted again from what is fetched now."""
    pages = t("pages").select(F.col("page_id"), U.normalize_url("url").alias("url"), "html")
    latest = first_rows(pages, ["url"], [F.desc("page_id")], 1)
    old = latest.select(
        "url", F.when(F.col("page_id") % 3 == 0, "Cariera: meniu").otherwise("titlu vechi").alias("title"),
        F.concat(F.lit("Text vechi al paginii, destul de lung pentru a fi păstrat "), F.col("page_id").cast("string")).alias("content"),
        F.lit("text/html").alias("mime_type"), F.col("page_id").alias("seq"),
    )
    store = corpus_store(t)
    store.apply(versioning.prepare(old), t.spark.createDataFrame([], "url string"), AT)
    status = store.refresh(fetched_pages(latest), AT)
    changes = store.change_lines().filter(F.size("hunks") > 0).groupBy("url").agg(F.count("*").alias("changes"))
    return store.documents.current().select("url").join(status.select("url", "status"), "url", "left").join(changes, "url", "left").select(
        "url", F.coalesce("status", F.lit("kept")).alias("status"), F.coalesce("changes", F.lit(0)).alias("changes")
    )
