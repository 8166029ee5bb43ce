"""Evidence rules: admission, scoring, gating, freshness, grounding and responses.

A hits frame has (query_id, question, pos, chunk_id, document_id,
document_title, document_url, content, page, section, dense_score,
lexical_score, rerank_score). A question has as many hits as retrieval lets
through, so grouping by ``query_id`` only meets bounded groups.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaero.functions import text as T
from quaero.operators import facts, questions
from quaero.operators.keyed import contains_join, first_rows, unfold
from quaero.session import cut_lineage
from quaero.values import contacts, patterns, replies, words

GATES = ["missing", "supported", "conflict"]


def is_junk(title: Column, content: Column) -> Column:
    """Captcha shells and generic pages without a usable body."""
    heading = T.strip(T.text_or_empty(title))
    body = T.text_or_empty(content)
    blob = F.concat(heading, F.lit("\n"), F.substring(body, 1, 600))
    bare = T.fold(heading)
    short = F.length(T.strip(T.collapse_spaces(body))) < 280
    return T.matches(blob, patterns.CAPTCHA_SHELL) | (
        bare.isin(patterns.GENERIC_TITLES)
        & (short | ((bare == "acte") & ~T.matches(body, patterns.PERMIT_BODY)))
    )


def hit_year(url: Column, title: Column, content: Column) -> Column:
    return T.latest_year_between(url, title, content)


def document_type(title: Column, url: Column, content: Column) -> Column:
    blob = F.lower(F.concat_ws(
        " ", T.text_or_empty(title), T.text_or_empty(url), F.substring(T.text_or_empty(content), 1, 200)
    ))
    label = F.lit(patterns.DOCUMENT_TYPE_DEFAULT)
    for name, needles in reversed(patterns.DOCUMENT_TYPES):
        label = F.when(T.contains_any(blob, needles), name).otherwise(label)
    return label


def _title_and_body() -> Column:
    return F.concat_ws(" ", T.text_or_empty("document_title"), T.text_or_empty("content"))


def score_hits(hits: DataFrame, today: datetime.date, min_rerank: float = 0.22,
               min_dense: float = 0.48, min_overlap: float = 0.18) -> DataFrame:
    """Adds ``admitted``, ``evidence_score``, ``content_overlap``, ``title_overlap``, ``year``,
    ``current``, ``list_mode``, ``rich``. ``hits`` also has answer_mode and wants_list."""
    q = F.col("question")
    title, content = T.text_or_empty("document_title"), T.text_or_empty("content")
    both = _title_and_body()
    job = questions.is_job_question(q)
    prepared = hits.withColumns(
        {
            "_q": T.tokens(q), "_body": T.fold(content), "_title": T.fold(title),
            "_job": job,
            "current": T.matches(q, patterns.GATE_CURRENT_WORDS) | questions.wants_current(q),
            "list_mode": F.coalesce(
                F.col("wants_list"), questions.wants_list(q) | (F.col("answer_mode") == "list")
            ),
            "_sector": F.when(job, facts.sector_in_question(q)),
            "_past": T.matches(both, patterns.PAST_EVENT),
            "_open": T.matches(both, patterns.OPEN_CALL),
            "year": hit_year(F.col("document_url"), F.col("document_title"), F.col("content")),
        }
    )
    bare_words = lambda c: F.array_except(T.folded_words(F.col(c)), T.string_array(words.STOP_WORDS))
    title_size = F.length(T.strip(title))
    prepared = prepared.withColumns(
        {
            "content_overlap": T.share_of(F.col("_q"), bare_words("_body")),
            "_raw_title_overlap": T.share_of(F.col("_q"), bare_words("_title")),
            "rich": F.size("_q") >= 2,
            "_chrome": sum(
                (F.col("_body").contains(p).cast("int") for p in words.CHROME_PHRASES),
                (~F.col("_job") & F.col("_body").contains(words.CHROME_PHRASE_UNLESS_JOB)).cast("int"),
            ),
        }
    )
    cov = F.col("content_overlap")
    prepared = prepared.withColumn(
        "title_overlap",
        F.when((title_size <= 12) & (F.col("_raw_title_overlap") > 0) & (cov < 0.12),
               F.col("_raw_title_overlap") * 0.25).otherwise(F.col("_raw_title_overlap")),
    )
    has_rr = F.col("rerank_score").isNotNull()
    rr, ds, lx = (F.coalesce(c, F.lit(0.0)) for c in ("rerank_score", "dense_score", "lexical_score"))
    tov, job_q, current = F.col("title_overlap"), F.col("_job"), F.col("current")
    open_call, past = F.col("_open"), F.col("_past")
    low = F.lower(content)
    placeholder = low.contains("[expire_date]") | low.contains("download is available until")
    barred = (
        (job_q & ~facts.matches_sector(F.col("document_title"), F.col("document_url"), F.col("content"), F.col("_sector")))
        | (job_q & current & (facts.vacancy_state(F.col("document_title"), F.col("content"), today) != "open"))
        | is_junk(F.col("document_title"), F.col("content"))
        | (placeholder & (F.length(T.strip(content)) < 400))
        | ((F.col("_chrome") >= 2) & (cov < 0.25))
        | ((job_q | T.matches(q, patterns.JOB_QUESTION_PARTS))
           & T.matches(both, patterns.HOLIDAY_NOISE_GATE) & ~T.matches(both, patterns.REAL_VACANCY_NOISE))
        | (current & past & (~open_call | job_q))
        | (has_rr & (rr < 0.18) & (cov < 0.22))
    )
    admits = (
        (has_rr & (rr >= max(min_rerank, 0.28)) & (cov >= 0.05))
        | (cov >= F.when(F.col("rich"), 0.18).otherwise(min_overlap))
        | (~has_rr & (ds >= min_dense) & (cov >= 0.12))
        | ((tov >= 0.45) & (cov >= 0.12) & (title_size > 20))
        | (job_q & open_call & ((cov >= 0.08) | (lx >= 0.75) | (rr >= 0.25)))
        | (F.col("list_mode") & open_call & ((lx >= 0.9) | (rr >= 0.3)))
    )
    points = lambda condition, value: F.when(condition, value).otherwise(0.0)
    year, now = F.col("year"), today.year
    score = (
        points(has_rr, rr * 1.6) + cov * 1.1 + ds * 0.25 + tov * 0.15
        + points((tov >= 0.45) & (title_size > 24), 0.15)
        + points(job_q & T.matches("_title", patterns.VACANCY_TITLE), 0.25)
        + points(job_q & open_call, 0.12)
        - points(F.col("_chrome") >= 2, 0.25)
        - points(past & ~open_call, 0.4)
        + F.when(~current | year.isNull(), 0.0).when(year >= now, 0.35)
        .when(year >= now - 1, 0.02).otherwise(-0.45)
    )
    scored = prepared.withColumn("admitted", ~barred & admits).withColumn("evidence_score", score)
    extra = ["admitted", "evidence_score", "content_overlap", "title_overlap", "year", "current",
             "list_mode", "rich"]
    # A filter on what comes out of an unfolded row is not carried below it, where it would work everything out again.
    found = F.struct(*[F.col(c) for c in extra])
    kept = [c for c in hits.columns if c not in extra]
    return scored.select(*kept, F.inline_outer(F.array(found)))




def best_per_document(scored: DataFrame, limit: int = 8, score: str = "evidence_score",
                      into: str = "usable_pos") -> DataFrame:
    """The best chunk of each document, the best ``limit`` documents of each question."""
    order = [F.desc(score), F.asc("pos"), F.asc("chunk_id")]
    one = first_rows(scored, ["query_id", "document_id"], order, 1)
    return first_rows(one, ["query_id"], order, limit, into)


def verify(hits: DataFrame, asked: DataFrame, today: datetime.date) -> tuple[DataFrame, DataFrame]:
    """The gate: ``(query_id, gate)`` for every question and its usable hits.

    ``asked`` has (query_id, question, answer_mode, wants_list); ``hits`` are
    those of ``asked``. Usable hits keep their columns, ``pos`` renumbered.
    """
    live = asked.filter(~questions.is_off_topic_for_gate("question"))
    with_mode = hits.drop("question").join(
        live.select("query_id", "question", "answer_mode", "wants_list"), "query_id"
    )
    scored = score_hits(with_mode, today).filter("admitted")
    per_query = Window.partitionBy("query_id")
    scored = scored.withColumns(
        {
            "_best": F.max("evidence_score").over(per_query),
            "_best_rr": F.max(F.coalesce("rerank_score", F.lit(0.0))).over(per_query),
            "_best_cov": F.max("content_overlap").over(per_query),
        }
    ).filter(
        (F.col("_best") >= 0.18)
        & ~((F.col("_best_rr") > 0) & (F.col("_best_rr") < 0.22) & (F.col("_best_cov") < 0.16)
          & ~F.col("list_mode"))
    )
    title_size = F.length(T.strip(T.text_or_empty("document_title")))
    wide = F.col("list_mode") | F.col("answer_mode").isin("list", "howto")
    strong = (F.col("content_overlap") >= 0.12) | ((F.col("title_overlap_raw") >= 0.4) & (title_size > 24))
    scored = scored.withColumn(
        "title_overlap_raw", T.overlap("question", "document_title")
    ).withColumn("_strong", strong)
    scored = scored.withColumn("_any_strong", F.max("_strong").over(per_query)).filter(
        wide | (F.col("_any_strong") & F.col("_strong"))
        | (~F.col("_any_strong") & (F.col("evidence_score") >= F.greatest(F.col("_best") * 0.5, F.lit(0.16))))
    )
    ranked = best_per_document(scored, 8).filter(wide | (F.col("usable_pos") <= 6))
    ranked = ranked.withColumn("_cov", F.max("content_overlap").over(per_query)).filter(
        ~(F.col("rich") & (F.col("_cov") < 0.10) & ~F.col("list_mode"))
    )
    usable = fresh_first(ranked, today.year)
    keep = [c for c in hits.columns if c not in ("pos", "question")]
    usable = cut_lineage(usable.select("question", *keep, F.col("fresh_pos").alias("pos")))
    found = facts.conflicts(usable).select("query_id").distinct().withColumn("_conflict", F.lit(True))
    have = usable.select("query_id").distinct().join(found, "query_id", "left").select(
        "query_id", F.when(F.col("_conflict"), "conflict").otherwise("supported").alias("gate")
    )
    gates = asked.select("query_id").join(have, "query_id", "left").select(
        "query_id", F.coalesce("gate", F.lit("missing")).alias("gate")
    )
    return gates, usable


def fresh_first(ranked: DataFrame, year_now: int, limit: int = 8) -> DataFrame:
    """For questions about the present: this year's hits, else last year's, else none.

    ``ranked`` has year, current, list_mode and usable_pos. A listing keeps
    only this year's hits, other answers put them first.
    """
    per_query = Window.partitionBy("query_id")
    year = F.coalesce("year", F.lit(0))
    marked = ranked.withColumn("_fresh", year >= year_now).withColumn("_recent", year >= year_now - 1)
    marked = marked.withColumn("_any_fresh", F.max("_fresh").over(per_query)).withColumn(
        "_any_recent", F.max("_recent").over(per_query)
    )
    kept = marked.filter(
        ~F.col("current")
        | (F.col("_any_fresh") & (F.col("_fresh") | ~F.col("list_mode")))
        | (~F.col("_any_fresh") & F.col("_any_recent") & F.col("_recent"))
    )
    first = F.when(F.col("current") & F.col("_any_fresh"), ~F.col("_fresh")).otherwise(F.lit(False))
    order = [first.asc(), F.asc("usable_pos")]
    return first_rows(kept, ["query_id"], order, limit, "fresh_pos").drop(
        "_fresh", "_recent", "_any_fresh", "_any_recent"
    )


def drop_noise(hits: DataFrame) -> DataFrame:
    """Hits without junk and without what the question's ``intent`` does not want.

    A filter that would leave a question empty is undone. Contact questions get
    their hits reordered.
    """
    per_query = Window.partitionBy("query_id")
    blob = F.concat(T.text_or_empty("document_title"), F.lit("\n"), T.text_or_empty("content"))
    spoken = _title_and_body()
    marked = hits.withColumn("_clean", ~is_junk(F.col("document_title"), F.col("content"))).withColumn(
        "_wanted",
        F.col("_clean")
        & F.when(
            F.col("intent") == "concurs",
            ~(T.matches(blob, patterns.HOLIDAY_NOISE) & ~T.matches(blob, patterns.REAL_VACANCY_NOISE)),
        )
        .when(F.col("intent") == "contact", ~T.matches(spoken, patterns.VACANCY_NOISE_FOR_CONTACT))
        .otherwise(True),
    )
    marked = marked.withColumn("_any_clean", F.max("_clean").over(per_query)).withColumn(
        "_any_wanted", F.max("_wanted").over(per_query)
    )
    kept = marked.filter(
        F.when(F.col("_any_wanted"), F.col("_wanted")).when(F.col("_any_clean"), F.col("_clean")).otherwise(True)
    )
    low = F.lower(spoken)
    base = F.coalesce(*[F.nullif(F.col(c), F.lit(0.0)) for c in ("rerank_score", "dense_score", "lexical_score")], F.lit(0.0))
    contact_score = (
        base + F.when(T.contains_any(low, ["contact", "telefon", "@"]), 0.35).otherwise(0.0)
        - F.when(T.matches(low, patterns.VACANCY_NOISE_FOR_CONTACT), 0.5).otherwise(0.0)
    )
    order = [
        F.when((F.col("intent") == "contact") & F.col("_any_clean"), -contact_score).otherwise(F.lit(0.0)).asc(),
        F.asc("pos"),
    ]
    return renumber(kept, order).drop("_clean", "_wanted", "_any_clean", "_any_wanted")


def renumber(hits: DataFrame, order: list[Column], keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return hits.withColumn(
        "_new", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.asc("chunk_id")))
    ).withColumn("pos", F.col("_new")).drop("_new")


def affinity_order(hits: DataFrame) -> DataFrame:
    """Hits reordered by how well they match the question's ``intent``."""
    blob = F.concat_ws("\n", T.text_or_empty("document_title"), T.text_or_empty("document_url"),
                       F.substring(T.text_or_empty("content"), 1, 1200))
    base = F.coalesce(*[F.nullif(F.col(c), F.lit(0.0)) for c in ("rerank_score", "dense_score", "lexical_score")], F.lit(0.0))
    total = base - F.when(F.length(T.strip(T.text_or_empty("document_title"))) <= 8, 0.4).otherwise(0.0)
    for name, rules in patterns.AFFINITY.items():
        for pattern, weight in rules:
            total = total + F.when((F.col("intent") == name) & T.matches(blob, pattern), weight).otherwise(0.0)
    known = F.col("intent").isin(list(patterns.AFFINITY))
    scored = hits.withColumn("affinity", total)
    return renumber(scored, [F.when(known, -F.col("affinity")).otherwise(F.lit(0.0)).asc(), F.asc("pos")])


def filter_by_year(hits: DataFrame, today: datetime.date) -> DataFrame:
    """For questions about the present: open vacancies, or hits of this year, else of the last.

    Without any dated hit all of them stay.
    """
    year = F.coalesce(hit_year(F.col("document_url"), F.col("document_title"), F.col("content")), F.lit(0))
    per_query = Window.partitionBy("query_id")
    marked = hits.withColumn("_year", year)
    marked = marked.withColumn("_top", F.max("_year").over(per_query))
    vacancy = F.col("intent") == "concurs"
    state = facts.vacancy_state(F.col("document_title"), F.col("content"), today)
    kept = marked.filter(
        F.when(~F.col("wants_current"), True)
        .when(vacancy, state == "open")
        .when(F.col("_top") >= today.year, F.col("_year") >= today.year)
        .when(F.col("_top") >= today.year - 1, F.col("_year") >= today.year - 1)
        .otherwise(True)
    )
    return renumber(kept.drop("_year", "_top"), [F.asc("pos")])


def needs_second_pass(asked: DataFrame, gates: DataFrame, usable: DataFrame, year_now: int) -> DataFrame:
    """Adds ``second_pass`` to ``asked``: is the evidence too thin to answer from?"""
    spoken = F.lower(F.concat_ws(" ", T.text_or_empty("document_title"), T.text_or_empty("content")))
    year = hit_year(F.col("document_url"), F.col("document_title"), F.col("content"))
    per = usable.groupBy("query_id").agg(
        F.count("*").alias("_n"),
        F.count_distinct("document_id").alias("_docs"),
        F.avg(F.length(T.text_or_empty("content"))).alias("_len"),
        F.max(F.coalesce(year, F.lit(0)) >= year_now).alias("_fresh"),
        F.max((F.col("pos") <= 3) & T.contains_any(spoken, ["telefon", "email", "@", "contact", "str."]))
        .alias("_contact"),
    )
    joined = asked.join(gates, "query_id", "left").join(per, "query_id", "left")
    n, docs = F.coalesce("_n", F.lit(0)), F.coalesce("_docs", F.lit(0))
    listing = (
        F.col("wants_list") | (F.col("answer_mode") == "list")
        | T.matches(F.lower("question"), patterns.RESEARCH_LIST_WORDS)
    )
    supported, current = F.col("gate") == "supported", F.col("wants_current")
    verdict = (
        F.when((F.col("intent") == "contact") & (n > 0) & F.col("_contact"), False)
        .when(listing, True)
        .when(current & (n > 0) & ~F.col("_fresh"), True)
        .when((F.col("intent") == "concurs") & supported & (n > 0), docs < 2)
        .when(supported & (n >= 2) & ~current & (F.col("_len") >= 180), False)
        .when((F.col("gate") == "missing") | (n < 1), True)
        .when(current & supported & (docs < 2), True)
        .otherwise(False)
    )
    return joined.withColumn("second_pass", verdict).drop("gate", "_n", "_docs", "_len", "_fresh", "_contact")


def merge_gates(asked: DataFrame, first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame],
                limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """Two verdicts into one: missing < supported < conflict, more hits, or a union of both."""
    counts = lambda hits, name: hits.groupBy("query_id").agg(
        F.count("*").alias(f"_{name}_n"), F.count_distinct("document_id").alias(f"_{name}_docs")
    )
    g1, u1 = first
    g2, u2 = second
    table = (
        asked.select("query_id", "wants_list", "answer_mode")
        .join(g1.withColumnRenamed("gate", "_g1"), "query_id", "left")
        .join(g2.withColumnRenamed("gate", "_g2"), "query_id", "left")
        .join(counts(u1, "a"), "query_id", "left").join(counts(u2, "b"), "query_id", "left")
        .na.fill(0, ["_a_n", "_a_docs", "_b_n", "_b_docs"])
        .na.fill("missing", ["_g1", "_g2"])
    )
    level = lambda c: F.array_position(T.string_array(GATES), F.col(c))
    listing = F.col("wants_list") | (F.col("answer_mode") == "list")
    choice = (
        F.when((F.col("_g1") == "supported") & (F.col("_g2") == "supported"), "both_first")
        .when(listing & (F.col("_g2") == "supported")
              & ((F.col("_g1") != "supported") | (F.col("_b_docs") >= F.col("_a_docs"))), "both_second")
        .when(listing, "first")
        .when((level("_g2") > level("_g1")) | ((F.col("_g1") == F.col("_g2")) & (F.col("_b_n") > F.col("_a_n"))), "second")
        .otherwise("first")
    )
    table = table.withColumn("_choice", choice)
    gates = table.select(
        "query_id",
        F.when(F.col("_choice").startswith("both"), "supported")
        .when(F.col("_choice") == "second", F.col("_g2")).otherwise(F.col("_g1")).alias("gate"),
    )
    pick = table.select("query_id", "_choice")
    a = u1.join(pick.filter("_choice != 'second'"), "query_id").withColumn(
        "_side", F.when(F.col("_choice") == "both_second", 1).otherwise(0))
    b = u2.join(pick.filter("_choice != 'first'"), "query_id").withColumn(
        "_side", F.when(F.col("_choice") == "both_first", 1).otherwise(0))
    both = a.unionByName(b, allowMissingColumns=True)
    single = both.filter(~F.col("_choice").startswith("both"))
    order = [F.asc("_side"), F.asc("pos"), F.asc("chunk_id")]
    merged = first_rows(both.filter(F.col("_choice").startswith("both")), ["query_id", "document_id"], order, 1)
    merged = first_rows(merged, ["query_id"], order, limit, "_new").withColumn("pos", F.col("_new")).drop("_new")
    return gates, single.unionByName(merged).drop("_choice", "_side")


def keep_open_vacancies(gates: DataFrame, usable: DataFrame, asked: DataFrame,
                        today: datetime.date) -> tuple[DataFrame, DataFrame]:
    """Last check of vacancy questions: right sector, still open; nothing left means missing."""
    meta = asked.select(
        "query_id", F.col("intent").alias("_intent"), F.col("wants_current").alias("_current"),
        facts.sector_in_question("question").alias("_sector"),
    )
    marked = usable.join(meta, "query_id")
    fits = facts.matches_sector(F.col("document_title"), F.col("document_url"), F.col("content"), F.col("_sector"))
    is_open = facts.vacancy_state(F.col("document_title"), F.col("content"), today) == "open"
    kept = marked.filter(
        (F.col("_intent") != "concurs") | (fits & (~F.col("_current") | is_open))
    ).select(*usable.columns)
    left = kept.select("query_id").distinct().withColumn("_left", F.lit(True))
    verdict = (
        gates.join(meta.select("query_id", "_intent"), "query_id").join(left, "query_id", "left")
        .select(
            "query_id",
            F.when((F.col("_intent") == "concurs") & F.col("_left").isNull(), "missing")
            .otherwise(F.col("gate")).alias("gate"),
        )
    )
    return verdict, kept


def confidence(asked: DataFrame, gates: DataFrame, usable: DataFrame, conflict_ids: DataFrame) -> DataFrame:
    """``(query_id, level, score)``. ``asked`` also has intent and known_contact (boolean)."""
    told = F.concat_ws(" ", T.text_or_empty("document_title"), T.text_or_empty("content"))
    best = usable.groupBy("query_id").agg(
        F.max(T.overlap("question", told)).alias("_ov"),
        F.max(F.coalesce("rerank_score", F.lit(0.0))).alias("_rr"),
    )
    flagged = conflict_ids.select("query_id").distinct().withColumn("_conflict", F.lit(True))
    joined = (
        asked.select("query_id", "intent", "known_contact").join(gates, "query_id", "left")
        .join(best, "query_id", "left").join(flagged, "query_id", "left")
    )
    raw = F.least(F.lit(0.95), 0.25 + F.col("_ov") * 0.45 + F.col("_rr") * 0.4)
    capped = F.when(F.col("_conflict"), F.least(raw, F.lit(0.55))).otherwise(raw)
    official = (F.col("intent") == "contact") & F.col("known_contact")
    missing = (F.col("gate") == "missing") | F.col("_ov").isNull()
    level = (
        F.when(official, "high").when(missing, "low").when(F.col("_conflict"), "medium")
        .when(capped >= 0.7, "high").when(capped >= 0.4, "medium").otherwise("low")
    )
    score = F.when(official, 0.92).when(missing, 0.15).otherwise(F.bround(capped, 3))
    return joined.select("query_id", level.alias("level"), score.alias("score"))


# --- answers ---------------------------------------------------------------------------

def claims_missing(answer: Column | str) -> Column:
    """Does a short answer without citations say that there is no evidence?"""
    value = T.strip(T.text_or_empty(answer))
    return (
        F.when(value == "", True)
        .when(T.matches(value, patterns.MISSING_WORD), True)
        .when((F.length(value) >= 280) | value.rlike(r"\[\d+\]"), False)
        .otherwise(T.matches(value, patterns.MISSING_ANSWER))
    )


def is_generic_blurb(answer: Column | str) -> Column:
    return T.matches(answer, patterns.GENERIC_ASSISTANT)


def citations(answer: Column | str, n_evidence: Column | int) -> Column:
    """The evidence numbers an answer cites, in order of first mention."""
    most = F.lit(n_evidence) if isinstance(n_evidence, int) else n_evidence
    found = F.transform(
        F.regexp_extract_all(T.text_or_empty(answer), F.lit(r"\[(\d+)\]"), F.lit(1)),
        lambda n: n.try_cast("int"),
    )
    return F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= most)))


def clean_answer(answer: Column | str) -> Column:
    text = F.regexp_replace(T.text_or_empty(answer), T.uni(patterns.ANSWER_PLACEHOLDER), "")
    text = F.regexp_replace(text, patterns.URL_IN_TEXT, "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]{2,}", " "), "\n{3,}", "\n\n")
    return T.strip(text)


def as_source(quote_chars: int = 400) -> Column:
    """The hit's columns as a source."""
    title, url, content = F.col("document_title"), F.col("document_url"), F.col("content")
    return F.struct(
        title.alias("document"), F.col("page"), F.col("section"),
        F.substring(T.text_or_empty("content"), 1, quote_chars).alias("quote"), url.alias("url"),
        document_type(title, url, content).alias("source_type"),
        hit_year(url, title, content).alias("year"),
    )


def source_types(usable: DataFrame) -> DataFrame:
    """Sources of each question with their kinds: ``(query_id, types, sources)``."""
    listed = usable.select("query_id", "pos", as_source().alias("source"))
    return listed.groupBy("query_id").agg(
        F.array_sort(F.collect_set("source.source_type")).alias("types"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("sources"),
    )


def ground_sources(answers: DataFrame, usable: DataFrame) -> DataFrame:
    """``(query_id, source_pos, source)``: cited hits, a clearly better one before them, or the best.

    ``answers`` has (query_id, question, answer, status).
    """
    meta = answers.select("query_id", "answer", "status", F.col("question").alias("_q"))
    told = F.concat_ws(" ", T.text_or_empty("document_title"), T.text_or_empty("content"))
    per_query = Window.partitionBy("query_id")
    hits = (
        usable.join(meta, "query_id").filter("status != 'missing'")
        .withColumn("_n", F.count("*").over(per_query))
        .withColumn("_refs", citations("answer", F.col("_n")))
        .withColumn("_at", F.row_number().over(per_query.orderBy("pos", "chunk_id")))
        .withColumn("_ov", F.when(F.coalesce("_q", F.lit("")) != "", T.overlap("_q", told)).otherwise(0.0))
    )
    hits = hits.withColumn(
        "_rank", F.row_number().over(per_query.orderBy(F.desc("_ov"), F.asc("_at")))
    ).withColumn("_cite", F.array_position("_refs", F.col("_at").cast("int")))
    hits = hits.withColumn("_first_cited_ov", F.max(F.when(F.col("_cite") == 1, F.col("_ov"))).over(per_query))
    url = F.coalesce("document_url", F.lit(""))
    cited_urls = F.collect_set(F.when(F.col("_cite") > 0, url)).over(per_query)
    hits = hits.withColumn("_cited_urls", cited_urls)
    better = (
        (F.col("_rank") == 1) & (url != "") & ~F.array_contains("_cited_urls", url)
        & (F.col("_ov") > F.col("_first_cited_ov") + 0.15) & (F.coalesce("_q", F.lit("")) != "")
    )
    cites = F.size("_refs") > 0
    order = (
        F.when(cites & better, 0).when(cites & (F.col("_cite") > 0), F.col("_cite"))
        .when(~cites & (F.col("_rank") <= 10), F.col("_rank"))
    )
    listed = hits.withColumn("_order", order).filter("_order is not null")
    key = F.concat_ws("|", url, F.coalesce("document_title", F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit("None")))
    unique = first_rows(listed.withColumn("_key", key), ["query_id", "_key"], [F.asc("_order")], 1)
    ranked = first_rows(unique, ["query_id"], [F.asc("_order")], 8, "source_pos")
    return ranked.filter(~(F.size("_refs") > 0) | (F.col("source_pos") <= 4)).select(
        "query_id", "source_pos", as_source().alias("source")
    )


def evidence_text(title: Column, content: Column, job: Column) -> Column:
    """The passage an answer is drawn from: cleaned, cut, or the title when nothing is left."""
    from quaero.operators.cleaning import scrub

    bare = F.regexp_replace(T.text_or_empty(content), T.uni(patterns.EVIDENCE_PLACEHOLDER), "")
    tight = T.strip(F.regexp_replace(scrub(bare), r"(?U)\s{2,}", " "))
    kept = T.let(tight, lambda x: F.when(job, facts.vacancy_excerpt(x)).otherwise(x))
    whole = T.let(kept, lambda x: F.when(F.length(x) < 40, T.strip(T.text_or_empty(title))).otherwise(x))
    return F.substring(whole, 1, 2200)


def evidence_blocks(usable: DataFrame) -> DataFrame:
    """``(query_id, blocks)``: the numbered passages of each question."""
    text = evidence_text(F.col("document_title"), F.col("content"), questions.is_job_question("question"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    block = F.concat(
        F.lit("document="), shown("document_title"), F.lit("\npage="), shown("page"),
        F.lit(" section="), shown("section"), F.lit("\nurl="), shown("document_url"),
        F.lit("\ntext="), text,
    )
    listed = usable.select("query_id", "pos", "chunk_id", block.alias("_block"))
    gathered = listed.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "_block"))).alias("_list")
    )
    return gathered.select(
        "query_id",
        F.transform("_list", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["_block"])).alias("blocks"),
    )


# --- topic links -----------------------------------------------------------------------

def _link_words(links: DataFrame, split: bool) -> DataFrame:
    """``(link_id, side, word)`` of each topic's words of four letters or more."""
    if split:
        words_of = lambda c: F.split(F.lower(T.text_or_empty(c)), r"[\s/,_-]+")
        sides = [("ro", words_of("topic_ro")), ("ru", words_of("topic_ru"))]
    else:
        sides = [
            ("ro", F.regexp_extract_all(F.lower(T.text_or_empty("topic_ro")), F.lit("[a-zăâîșț]{4,}"), F.lit(0))),
            ("ru", F.regexp_extract_all(F.lower(T.text_or_empty("topic_ru")), F.lit("[a-zа-яё]{4,}"), F.lit(0))),
        ]
    parts = [
        unfold(links.withColumn("side", F.lit(name)), ["link_id", "side"], found, "at", "word")
        for name, found in sides
    ]
    return parts[0].unionByName(parts[1]).filter(F.length("word") >= 4)


def topic_scores(asked: DataFrame, links: DataFrame, split: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(_q, topic_id, score)``, two points per word of a topic that a question in lower case holds, and
    ``(link_id, topic_id)``. Every distinct question and topic is scored once; a topic is named by its first link."""
    named = links.groupBy("topic_ro", "topic_ru").agg(F.min("link_id").alias("topic_id"))
    topics = named.withColumnRenamed("topic_id", "link_id")
    said = asked.select(F.lower(T.text_or_empty("question")).alias("_q")).distinct()
    found = contains_join(said, "_q", _link_words(topics, split), "word")
    scores = found.groupBy("_q", F.col("link_id").alias("topic_id")).agg((F.count("*") * 2).alias("score"))
    same = links["topic_ro"].eqNullSafe(named["topic_ro"]) & links["topic_ru"].eqNullSafe(named["topic_ru"])
    return scores, links.join(named, same).select("link_id", "topic_id")


def _best_topics(asked: DataFrame, scores: DataFrame) -> DataFrame:
    """``(query_id, link_id, score)``: the best topic is chosen once per distinct question."""
    low = asked.select("query_id", F.lower(T.text_or_empty("question")).alias("_q"))
    best = first_rows(scores, ["_q"], [F.desc("score"), F.asc("topic_id")], 1)
    return low.join(best, "_q").select("query_id", F.col("topic_id").alias("link_id"), "score")


def topic_link(asked: DataFrame, links: DataFrame) -> DataFrame:
    """Each question's best topic link, if any of its words occur."""
    return _best_topics(asked, topic_scores(asked, links)[0]).join(links, "link_id")


def next_action(asked: DataFrame, links: DataFrame, evidence_urls: DataFrame) -> DataFrame:
    """``(query_id, label, url, contact)``: the best topic link, else the first evidence page.

    ``evidence_urls`` has (query_id, pos, url). A link that is itself evidence
    gains three points; it is found by its address, not by trying every link.
    """
    scores, topic_of = topic_scores(asked, links, split=True)
    bare = F.rtrim("url", F.lit("/"))
    low = asked.select("query_id", F.lower(T.text_or_empty("question")).alias("_q"))
    as_evidence = (
        evidence_urls.select("query_id", F.col("url").alias("_bare")).distinct()
        .join(links.filter("url is not null").select("link_id", bare.alias("_bare")), "_bare")
        .join(topic_of, "link_id").join(low, "query_id").join(scores, ["_q", "topic_id"], "left")
        .select("query_id", "link_id", (F.coalesce("score", F.lit(0)) + 3).alias("score"))
    )
    either = _best_topics(asked, scores).unionByName(as_evidence)
    best = first_rows(either, ["query_id"], [F.desc("score"), F.asc("link_id")], 1).join(links, "link_id").select(
        "query_id",
        F.coalesce(F.nullif("contact_label", F.lit("")), F.col("topic_ro")).alias("label"),
        "url", F.col("contact_value").alias("contact"),
    )
    pages = evidence_urls.filter((F.col("url") != "") & ~bare.isin(contacts.FRONT_PAGES))
    page = first_rows(pages, ["query_id"], [F.asc("pos"), F.asc("url")], 1).select(
        "query_id", F.lit(replies.OPEN_SOURCE_LABEL).alias("label"), "url", F.lit(None).cast("string").alias("contact")
    )
    return best.unionByName(page.join(best, "query_id", "left_anti"))


def contact_for(asked: DataFrame, links: DataFrame) -> DataFrame:
    """``(query_id, label, url, contact)``: the institution's, else the best topic's, else the front desk's.

    ``asked`` has institution. Topics are ranked by the share of the question's
    words that they hold, at least 0.08; questions of the same words and topics of
    the same words are compared once, a topic is named by its first link.
    """
    spark = asked.sparkSession
    known = questions.institutions(spark).select(
        "institution", F.col("name").alias("label"), "url",
        F.concat_ws(" · ", "address", "phone", "email").alias("contact"),
    )
    by_institution = asked.join(known, "institution").select("query_id", "label", "url", "contact")
    rest = asked.join(by_institution.select("query_id"), "query_id", "left_anti").select(
        "query_id", "question", F.array_sort(T.tokens(F.lower("question"))).alias("_said")
    )
    said = rest.select("_said").distinct().withColumn("_n", F.size("_said"))
    topic = F.concat_ws(" ", T.text_or_empty("topic_ro"), T.text_or_empty("topic_ru"))
    named = links.groupBy(F.array_sort(T.tokens(topic)).alias("_topic")).agg(F.min("link_id").alias("link_id"))
    told = named.select("link_id", F.explode("_topic").alias("word"))
    shares = unfold(said, ["_said", "_n"], "_said", "_at", "word").join(told, "word").groupBy("_said", "link_id").agg(
        (F.count("*") / F.first("_n")).alias("share")
    ).filter("share >= 0.08")
    best = first_rows(shares, ["_said"], [F.desc("share"), F.asc("link_id")], 1).join(links, "link_id").select(
        "_said", F.lit(True).alias("_found"), F.coalesce(F.nullif("contact_label", F.lit("")), F.col("topic_ro")).alias("_label"),
        F.col("url").alias("_url"), F.col("contact_value").alias("_contact"),
    )
    permit = T.matches(F.lower("question"), patterns.PERMIT_OFFICE_WORDS)
    choose = lambda own, i: F.when(F.col("_found"), F.col(own)).when(permit, contacts.PERMIT_OFFICE[i]).otherwise(contacts.FRONT_DESK[i])
    others = rest.join(best, "_said", "left").select(
        "query_id", choose("_label", 0).alias("label"), choose("_url", 1).alias("url"), choose("_contact", 2).alias("contact")
    )
    return by_institution.unionByName(others)


# --- responses -------------------------------------------------------------------------

def missing_answer(language: Column, question: Column, no_results: Column) -> Column:
    vacancy = questions.is_job_question(question) & questions.wants_current(question)
    sector = facts.sector_in_question(question)
    where = F.coalesce(F.concat(F.lit(replies.SECTOR_PHRASE), F.initcap(sector)), F.lit(""))
    pick = lambda table: questions._by_language(table, language)
    return F.when(
        vacancy, F.replace(pick(replies.NO_OPEN_VACANCY), F.lit("%s"), where)
    ).when(no_results, pick(replies.NO_RESULTS)).otherwise(pick(replies.NOT_CONFIRMED))


def conflict_answer(language: Column, pair_field: Column, left: Column, right: Column) -> Column:
    unit = questions._by_language(replies.DAY_UNIT, language)

    def shown(side: Column) -> Column:
        return F.when(
            (pair_field == "duration_days") & (F.size(side["days"]) > 0),
            F.concat_ws(" ", F.get(side["days"], F.lit(0)).cast("string"), unit),
        ).otherwise(side["value"])

    templates = {code: F.format_string(t, shown(left), shown(right)) for code, t in replies.CONFLICT.items()}
    return F.when(language == "ru", templates["ru"]).when(language == "en", templates["en"]).otherwise(templates["ro"])


def contact_card(language: Column, name: Column, address: Column, phone: Column, email: Column, url: Column) -> Column:
    cards = {code: F.format_string(t, name, address, phone, email, url) for code, t in replies.CONTACT_CARD.items()}
    card = F.when(language == "ru", cards["ru"]).when(language == "en", cards["en"]).otherwise(cards["ro"])
    return F.when(name.isNotNull(), card)


def response_status(relevant: Column, gate: Column, has_conflict: Column, contact_answer: Column,
                    answer: Column) -> Column:
    """What the response finally is: out_of_scope, conflict, missing or supported."""
    unsupported = is_generic_blurb(answer) | claims_missing(answer)
    return (
        F.when(~relevant, "out_of_scope")
        .when(has_conflict, "conflict")
        .when(contact_answer.isNotNull(), "supported")
        .when((gate == "missing") | unsupported, "missing")
        .otherwise(F.when(gate == "conflict", "supported").otherwise(gate))
    )
