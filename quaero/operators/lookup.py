"""Document and chunk lookups around a question batch."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.functions import urls as U
from quaero.operators import facts
from quaero.operators.gram_index import GramIndex
from quaero.operators.keyed import contains_join, first_rows, sent
from quaero.session import cut_lineage
from quaero.values import patterns

FIRST_CHUNKS = 12


def _chunk_order() -> list[Column]:
    return [F.asc("chunk_id")]


def as_hits(rows: DataFrame, dense: float | None, lexical: float | None, rerank: float | None) -> DataFrame:
    score = lambda v: F.lit(v).cast("double")
    return rows.withColumns(
        {"dense_score": score(dense), "lexical_score": score(lexical), "rerank_score": score(rerank)}
    )


def hit_view(hits: DataFrame) -> DataFrame:
    """Hits as shown: the first 600 characters as quote."""
    return hits.select(
        "query_id", "pos", "chunk_id", "document_id", F.col("document_title").alias("document"),
        F.col("document_url").alias("url"), "page", "section",
        F.substring(T.text_or_empty("content"), 1, 600).alias("quote"),
        "dense_score", "lexical_score", "rerank_score",
    )


def exact_phrase(phrases: DataFrame, chunks: DataFrame, documents: DataFrame, limit: int = 5,
                 grams: GramIndex | None = None) -> DataFrame:
    """Chunks that hold a phrase, in any case: the first by number.

    ``phrases`` has (query_id, phrase). A phrase is looked up once, however many
    ask for it: in the stored index ``grams``, or in the texts themselves, where
    chunks without its first four characters never meet it.
    """
    needles = phrases.select("query_id", F.lower(T.strip("phrase")).alias("needle"))
    distinct = needles.select("needle").distinct()
    if grams is not None:
        first = grams.first_holding(distinct, chunks, limit)
    else:
        texts = chunks.select("chunk_id", F.lower("content").alias("_low"))
        found = contains_join(texts, "_low", distinct, "needle").select("needle", "chunk_id")
        first = first_rows(found, ["needle"], _chunk_order(), limit, "pos")
    few = cut_lineage(needles.join(first, "needle").drop("needle"))
    # Numbers go to the texts, not these to them.
    held = chunks.select("chunk_id", "document_id", F.substring("content", 1, 280).alias("content")).join(
        sent(cut_lineage(few.select("chunk_id").distinct())), "chunk_id", "left_semi"
    )
    placed = cut_lineage(few.join(held, "chunk_id"))
    titles = documents.select("document_id", "title", "url").join(
        sent(cut_lineage(placed.select("document_id").distinct())), "document_id", "left_semi"
    )
    return placed.join(titles, "document_id").select("query_id", "pos", "chunk_id", "document_id", "title", "url",
             F.substring("content", 1, 280).alias("snippet"))


def first_chunks(chunks: DataFrame, n: int = 1) -> DataFrame:
    return first_rows(chunks, ["document_id"], _chunk_order(), n, "_at")


def announcement_chunks(chunks: DataFrame, documents: DataFrame, today: datetime.date) -> DataFrame:
    """Each document's chunk that best tells a deadline: an open one, any one, else the first."""
    few = first_chunks(chunks, FIRST_CHUNKS).join(documents.select("document_id", "title"), "document_id")
    rank = (
        F.when(facts.vacancy_state(F.col("title"), F.col("content"), today) == "open", 0)
        .when(F.size(facts.application_deadlines("content")) > 0, 1).otherwise(2)
    )
    best = few.withColumn("_rank", rank)
    return first_rows(best, ["document_id"], [F.asc("_rank"), F.asc("_at")], 1).drop("_rank", "_at", "title")


def _document_hits(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """Documents with their chosen chunk; one without chunks gives its own text."""
    picked = chosen.select(
        "document_id", "chunk_id", F.col("content").alias("_chunk"), "page", "section"
    )
    return documents.join(picked, "document_id", "left").withColumn(
        "chunk_id", F.coalesce("chunk_id", -F.col("document_id"))
    ).withColumn("_text", T.text_or_empty(F.coalesce("_chunk", "content")))


def topic_rescue(terms: DataFrame, documents: DataFrame, chunks: DataFrame, limit: int = 6,
                 job_only: bool = False, today: datetime.date | None = None) -> DataFrame:
    """The newest documents whose title or address holds one of a question's terms.

    ``terms`` has (query_id, term_pos, term); the first five of four letters or
    more count. Titles and addresses are short, so the substring join is too.
    """
    clean = terms.withColumn("term", T.strip("term")).filter(F.length("term") >= 4)
    clean = first_rows(clean, ["query_id"], [F.asc("term_pos")], 5).withColumn("_low", F.lower("term"))
    heads = documents.select("document_id", F.lower(F.concat_ws("\n", T.text_or_empty("title"), T.text_or_empty("url"))).alias("_head"))
    if job_only:
        jobs = documents.filter(
            T.like_any(F.col("title"), patterns.JOB_ONLY_TITLE_LIKE)
            | T.like_any(F.col("url"), patterns.JOB_ONLY_URL_LIKE)
            | T.like_any(F.col("content"), patterns.JOB_ONLY_CONTENT_LIKE)
        )
        heads = heads.join(jobs.select("document_id"), "document_id", "left_semi")
    # The newest of a question are among the newest of its terms, which are looked up once each.
    named = contains_join(heads, "_head", clean.select("_low").distinct(), "_low").select("_low", "document_id")
    per_term = first_rows(named, ["_low"], [F.desc("document_id")], limit * 3)
    found = clean.select("query_id", "_low").join(per_term, "_low").select("query_id", "document_id").distinct()
    newest = first_rows(found, ["query_id"], [F.desc("document_id")], limit * 3, "_new")
    needed = newest.select("document_id").distinct()
    few = documents.join(needed, "document_id", "left_semi")
    own = chunks.join(needed, "document_id", "left_semi")
    chosen = announcement_chunks(own, few, today) if job_only else first_chunks(own).drop("_at")
    rows = newest.join(_document_hits(few, chosen), "document_id")
    blob = T.fold(F.concat_ws(" ", T.text_or_empty("title"), T.text_or_empty("url"), F.substring(T.text_or_empty("content"), 1, 800)))
    bare = clean.groupBy("query_id").agg(F.collect_set(T.fold("term")).alias("_bare"))
    sure = rows.withColumn("_blob", blob).join(bare, "query_id").filter(
        F.exists("_bare", lambda t: F.contains(F.col("_blob"), t))
    )
    few_hits = first_rows(sure, ["query_id"], [F.asc("_new")], limit, "pos").select(
        "query_id", "pos", "chunk_id", "document_id", F.col("title").alias("document_title"),
        F.col("url").alias("document_url"), F.substring("_text", 1, 5000 if job_only else 2000).alias("content"),
        "page", "section",
    )
    return as_hits(few_hits, 0.45, 0.35, 0.35)


def vacancy_hits(documents: DataFrame, chunks: DataFrame, today: datetime.date, limit: int = 8) -> DataFrame:
    """Vacancy listings first, then single announcements, newest first, without noise.

    Listings are ranked by how many current announcements they show, at most
    two per host and six in all. The list is the same for every question.
    """
    title, url, content = F.col("title"), F.col("url"), F.col("content")
    noisy = T.like_any(title, patterns.NOISE_TITLE_LIKE)
    low_url = F.lower(T.text_or_empty(url))
    head = F.substring(T.text_or_empty(content), 1, 8000)
    quality = (
        F.size(F.regexp_extract_all(head, F.lit(patterns.HUB_YEAR), F.lit(0)))
        + F.size(T.find_all(head, patterns.HUB_JOB))
        + F.when(low_url.contains("posturi-vacante"), 5).otherwise(0)
        + F.when(low_url.contains("chisinau.md"), 4).otherwise(0)
        - F.when(low_url.rlike(patterns.HUB_PAGED_URL), 2).otherwise(0)
    )
    hubs = documents.filter(
        (T.like_any(url, patterns.HUB_URL_LIKE) | T.like_any(title, patterns.HUB_TITLE_LIKE)) & ~noisy
    ).orderBy(F.desc("document_id")).limit(40).withColumn("_quality", quality).withColumn(
        "_host", F.when(U.authority(T.text_or_empty(url)) == "", "unknown").otherwise(F.lower(U.authority(T.text_or_empty(url))))
    )
    best_first = [F.desc("_quality"), F.desc("document_id")]
    hubs = first_rows(hubs, ["_host"], best_first, 2).orderBy(*best_first).limit(6)
    hubs = hubs.select(*documents.columns, F.lit(0).alias("_list"), F.col("_quality").cast("long").alias("_order"))
    others = documents.filter(
        (T.like_any(title, patterns.CONTEST_TITLE_LIKE) | T.like_any(url, patterns.CONTEST_URL_LIKE)) & ~noisy
    ).orderBy(F.desc("document_id")).limit(limit * 6).select(
        *documents.columns, F.lit(1).alias("_list"), F.lit(0).cast("long").alias("_order")
    )
    rows = first_rows(hubs.unionByName(others), ["document_id"], [F.asc("_list")], 1)
    low_title = F.lower(T.text_or_empty(title))
    hub = (
        low_url.contains("posturi-vacante") | low_url.contains("functii-vacante")
        | T.strip(low_title).isin(patterns.HUB_TITLES)
    )
    blob = F.concat(low_title, F.lit("\n"), F.substring(T.text_or_empty(content), 1, 1200))
    this_year = r"|\d{2}\.\d{2}\.%d" % today.year
    finished = T.matches(content, patterns.FINISHED_BODY) & ~T.matches(content, patterns.STILL_OPEN_BODY)
    good = rows.withColumn("_hub", hub).filter(
        ~T.matches(blob, patterns.HOLIDAY_NOISE)
        & (~F.col("_hub") | T.matches(content, patterns.HUB_BODY + this_year))
        & (F.col("_hub") | ~T.matches(low_title, patterns.WINNER_TITLE))
        & ~finished
    )
    ranked = good.orderBy("_list", F.desc("_order"), F.desc("document_id")).limit(limit)
    own = chunks.join(ranked.select("document_id"), "document_id", "left_semi")
    told = _document_hits(ranked, announcement_chunks(own, ranked, today))
    text = F.when(F.col("_hub"), F.substring(T.text_or_empty("content"), 1, 3200)).otherwise(F.substring("_text", 1, 5000))
    pick = lambda a, b: F.when(F.col("_hub"), a).otherwise(b)
    placed = first_rows(
        told.withColumn("_one", F.lit(1)), ["_one"],
        [F.asc("_list"), F.desc("_order"), F.desc("document_id")], limit, "pos",
    )
    return placed.select(
        "pos", "chunk_id", "document_id", F.col("title").alias("document_title"),
        F.col("url").alias("document_url"), text.alias("content"), "page", "section",
        pick(0.72, 0.62).alias("dense_score"), pick(0.98, 0.9).alias("lexical_score"),
        pick(0.78, 0.58).alias("rerank_score"),
    )


def research_merge(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Existing hits, then found ones whose document, page and opening are new.

    ``found`` also has query_no, the place of the wording that found it.
    """
    key = [F.col("document_id"), F.col("page"), F.substring(T.text_or_empty("content"), 1, 80).alias("_opening")]
    first = existing.withColumn("query_no", F.lit(-1)).unionByName(found, allowMissingColumns=True)
    keyed = first.select("*", key[2])
    order = [F.asc("query_no"), F.asc("pos"), F.asc("chunk_id")]
    ranked = keyed.withColumn("_page", F.coalesce("page", F.lit(-1)))
    old = ranked.filter("query_no < 0")
    fresh = first_rows(ranked, ["query_id", "document_id", "_page", "_opening"], order, 1).filter("query_no >= 0")
    both = old.unionByName(fresh)
    from pyspark.sql.window import Window

    return both.withColumn(
        "pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    ).drop("_opening", "_page", "query_no")


def related_chunks(hits: DataFrame, chunks: DataFrame, documents: DataFrame, per_doc: int = 3,
                   max_extra: int = 12, max_docs: int = 8) -> DataFrame:
    """More chunks of the documents already hit, without those hit themselves."""
    docs = hits.groupBy("query_id", "document_id").agg(F.min("pos").alias("_doc_pos"))
    docs = cut_lineage(first_rows(docs, ["query_id"], [F.asc("_doc_pos"), F.asc("document_id")], max_docs))
    needed = sent(cut_lineage(docs.select("document_id").distinct()))
    openings = first_chunks(chunks.join(needed, "document_id", "left_semi"), per_doc + 2)
    more = docs.join(openings, "document_id").join(
        hits.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti"
    )
    few = first_rows(more, ["query_id"], [F.asc("_doc_pos"), F.asc("document_id"), F.asc("chunk_id")], max_extra, "pos")
    titles = documents.select(
        "document_id", F.col("title").alias("document_title"), F.col("url").alias("document_url")
    )
    rows = few.join(titles.join(needed, "document_id", "left_semi"), "document_id").select(
        "query_id", "pos", "chunk_id", "document_id", "document_title", "document_url", "content", "page", "section"
    )
    return as_hits(rows, 0.5, 0.5, 0.45)


def read_documents(wanted: DataFrame, documents: DataFrame, preview: int = 2500) -> DataFrame:
    """One document per request by id, exact address, or the last 80 characters of it.

    ``wanted`` has (request_id, document_id, url). An address that no document
    has exactly is looked for as the end of a stored one: its last 80
    characters, or all of a shorter one, equal the stored address's last as
    many. There are at most 80 such lengths.
    """
    rows = documents.select("document_id", "url")
    by_id = wanted.filter("document_id is not null").select("request_id", "document_id").join(rows, "document_id")
    asked = wanted.filter("document_id is null and url is not null").select("request_id", F.col("url").alias("_url"))
    exact = asked.join(rows, F.col("_url") == F.col("url"))
    rest = asked.join(exact.select("request_id"), "request_id", "left_anti")
    tail = F.lower(F.when(F.length("_url") > 80, F.substring("_url", -80, 80)).otherwise(F.col("_url")))
    ends = rest.withColumn("_tail", tail).filter("_tail <> ''")
    lengths = [r[0] for r in ends.select(F.length("_tail")).distinct().collect()]
    low, n = F.lower("url"), F.col("_n")
    cut = rows.withColumn("_n", F.explode(F.array(*[F.lit(x) for x in lengths]).cast("array<int>")))
    inside = cut.filter(F.length(low) >= n).withColumn("_tail", F.right(low, n)).join(ends, "_tail")
    columns = ["request_id", "document_id"]
    every = (
        by_id.select(*columns).withColumn("_rank", F.lit(0))
        .unionByName(exact.select(*columns).withColumn("_rank", F.lit(1)))
        .unionByName(inside.select(*columns).withColumn("_rank", F.lit(2)))
    )
    # Numbers and addresses decide; titles and texts are read for what is chosen.
    chosen = first_rows(every, ["request_id"], [F.asc("_rank"), F.asc("document_id")], 1).drop("_rank")
    return chosen.join(documents.select(
        "document_id", "title", "url", "mime_type", F.substring(T.text_or_empty("content"), 1, preview).alias("preview")
    ), "document_id").select("request_id", "document_id", "title", "url", "mime_type", "preview")


def document_chunks(wanted: DataFrame, chunks: DataFrame, limit: int = 8, chars: int = 500) -> DataFrame:
    """The first chunks of each wanted document; ``wanted`` has (document_id)."""
    own = chunks.join(wanted.select("document_id").distinct(), "document_id", "left_semi")
    return first_rows(own, ["document_id"], _chunk_order(), limit, "place").select(
        "document_id", "place", "chunk_id", "page", "section", F.substring("content", 1, chars).alias("text")
    )


def document_previews(wanted: DataFrame, documents: DataFrame, limit: int = 8, chars: int = 1800) -> DataFrame:
    """Previews of each question's first documents; ``wanted`` has (query_id, document_id, pos)."""
    unique = wanted.groupBy("query_id", "document_id").agg(F.min("pos").alias("_pos"))
    few = first_rows(unique, ["query_id"], [F.asc("_pos"), F.asc("document_id")], limit, "place")
    return few.join(documents, "document_id").select(
        "query_id", "place", "document_id", "title", "url",
        F.substring(T.text_or_empty("content"), 1, chars).alias("preview"),
        F.length(T.text_or_empty("content")).alias("chars"),
    )


def find_by_url(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """Each request's document by exact address, else the newest on the same host.

    The newest document per host is found first, one row per host.
    """
    rows = documents.filter("url is not null").select("document_id", "title", "url")
    exact = asked.select("request_id", F.col("url").alias("_url")).join(rows, F.col("_url") == F.col("url"))
    rest = asked.join(exact.select("request_id"), "request_id", "left_anti")
    newest = rows.withColumn("_host", F.lower(U.authority("url"))).groupBy("_host").agg(
        F.max_by(F.struct("document_id", "title", "url"), "document_id").alias("_doc")
    )
    hosted = rest.withColumn("_host", F.lower(U.authority("url"))).filter("_host != ''").join(newest, "_host")
    columns = ["request_id", "document_id", "title", "url"]
    return exact.select(*columns).unionByName(hosted.select("request_id", "_doc.*"))


