"""A batch of questions through every step up to the response, without a language model.

The answer text itself is an input: ``answers`` may bring it per question; where
it is absent the response is the evidence and the rules' verdict.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators import evidence, facts, lookup, questions
from quaero.operators.fusion import Scorer, merge_hits
from quaero.plans import search
from quaero.plans.search import Corpus
from quaero.session import cut_lineage


@dataclass
class Answers:
    """Frames by question: state, gate, usable hits, conflicts and the response."""

    state: DataFrame
    gates: DataFrame
    usable: DataFrame
    conflicts: DataFrame
    response: DataFrame


def analyze(asked: DataFrame, today: datetime.date, classifier=None, assistant: str = "Asistent") -> DataFrame:
    """Question state: metadata, scope, institution, search text and other wordings."""
    ui = "ui_language" if "ui_language" in asked.columns else None
    state = questions.analyze_for_search(asked, today.year, ui_language=ui)
    state = questions.scope(state, classifier=classifier, assistant=assistant)
    state = state.withColumn("institution", questions.institution("question"))
    return state.withColumn(
        "search_query", questions.search_query("question", F.col("intent"), F.col("institution"))
    ).withColumn(
        "queries", questions.query_list(questions.alternative_queries("question", F.col("intent"), F.col("institution")))
    )


def _filtered(hits: DataFrame, state: DataFrame, today: datetime.date) -> DataFrame:
    meta = state.select("query_id", "intent", "wants_current")
    columns = hits.columns
    clean = evidence.drop_noise(hits.join(meta, "query_id"))
    return evidence.filter_by_year(clean, today).select(*columns)


def answer_batch(corpus: Corpus, asked: DataFrame, today: datetime.date, top_k: int = 5,
                 scorer: Scorer = T.overlap, embed_fn=None, classifier=None,
                 assistant: str = "Asistent", answers: DataFrame | None = None) -> Answers:
    """``asked`` has (query_id, question[, ui_language])."""
    state = cut_lineage(analyze(asked, today, classifier, assistant))
    live = state.filter("scope.relevant")
    hits = _filtered(search.search_with_rescue(corpus, live, today, top_k, scorer, embed_fn), live, today)
    hits = cut_lineage(hits)
    first = evidence.verify(hits, live, today)
    first = (cut_lineage(first[0]), cut_lineage(first[1]))

    again = evidence.needs_second_pass(live, *first, today.year).filter("second_pass").drop("second_pass")
    again = cut_lineage(again)
    mine = hits.join(again.select("query_id"), "query_id", "left_semi")
    wider = search.broaden(corpus, again, mine, today, max(top_k, 10), scorer, embed_fn)
    wider = search.research(corpus, again, cut_lineage(wider), max(4, top_k - 1), scorer, embed_fn)
    wider = cut_lineage(_filtered(wider.select(*hits.columns), again, today))
    second = evidence.verify(wider, again, today)
    second = (cut_lineage(second[0]), cut_lineage(second[1]))
    once = live.join(again.select("query_id"), "query_id", "left_anti")
    merged = evidence.merge_gates(
        again,
        tuple(f.join(again.select("query_id"), "query_id", "left_semi") for f in first), second,
    )
    gates = first[0].join(once.select("query_id"), "query_id", "left_semi").unionByName(merged[0])
    usable = first[1].join(once.select("query_id"), "query_id", "left_semi").unionByName(
        merged[1], allowMissingColumns=True
    )

    usable = _read_more(corpus, usable, live)
    gates, usable = evidence.keep_open_vacancies(gates, usable, live, today)
    gates, usable = cut_lineage(gates), cut_lineage(usable)
    conflicts = cut_lineage(facts.conflicts(usable))
    return Answers(state, gates, usable, conflicts,
                   respond(corpus, state, gates, usable, conflicts, hits, answers))


def _read_more(corpus: Corpus, usable: DataFrame, live: DataFrame) -> DataFrame:
    """Longer previews of the documents hit, and more of their chunks."""
    previews = lookup.document_previews(usable, corpus.documents, 6).select("query_id", "document_id", "preview")
    first = usable.groupBy("query_id", "document_id").agg(F.min("pos").alias("_first"))
    current = live.select("query_id", ((F.col("intent") == "concurs") & F.col("wants_current")).alias("_current"))
    longer = (
        usable.join(previews, ["query_id", "document_id"], "left").join(first, ["query_id", "document_id"])
        .join(current, "query_id")
    )
    fuller = (
        (F.length("preview") >= 80) & (F.length("preview") > F.length(T.text_or_empty("content")))
        & (F.col("pos") == F.col("_first")) & ~F.col("_current")
    )
    read = longer.withColumn("content", F.when(fuller, F.col("preview")).otherwise(F.col("content"))).select(*usable.columns)
    extra = lookup.related_chunks(read, corpus.chunks, corpus.documents, 3, 10).join(
        live.select("query_id", "question"), "query_id"
    )
    return merge_hits([read, extra], limit=12).select(*usable.columns)


def respond(corpus: Corpus, state: DataFrame, gates: DataFrame, usable: DataFrame, conflicts: DataFrame,
            hits: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One response row per question."""
    spark = state.sparkSession
    known = questions.institutions(spark)
    contact = state.join(known, "institution", "left")
    card = F.when(
        F.col("intent") == "contact",
        evidence.contact_card(F.col("language"), F.col("name"), F.col("address"), F.col("phone"), F.col("email"),
                              F.col("url")),
    )
    base = contact.select(*state.columns, F.col("name").isNotNull().alias("known_contact"), card.alias("contact_answer"))
    gated = base.select("query_id", "contact_answer").join(gates, "query_id", "left").select(
        "query_id", F.when(F.col("contact_answer").isNotNull(), "supported").otherwise(F.coalesce("gate", F.lit("missing"))).alias("gate")
    )
    sure = evidence.confidence(base, gated, usable, conflicts)
    pair = conflicts.filter("pair = 1").select(
        "query_id", "field", F.col("left").alias("_left"), F.col("right").alias("_right")
    )
    all_pairs = conflicts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pair", "field", "left", "right"))).alias("conflicts")
    )
    found = hits.select("query_id").distinct().withColumn("_found", F.lit(True))
    text = answers.select("query_id", "answer") if answers is not None else state.select(
        "query_id", F.lit("-").alias("answer")
    )
    rows = (
        base.join(gated, "query_id").join(sure, "query_id").join(pair, "query_id", "left")
        .join(all_pairs, "query_id", "left").join(found, "query_id", "left").join(text, "query_id", "left")
    )
    lang = F.col("language")
    status = evidence.response_status(
        F.col("scope.relevant"), F.col("gate"), F.col("_left").isNotNull(), F.col("contact_answer"), F.col("answer")
    )
    rows = rows.withColumn("status", status)
    missing = evidence.missing_answer(lang, F.col("question"), F.col("_found").isNull())
    disagreement = evidence.conflict_answer(lang, F.col("field"), F.col("_left"), F.col("_right"))
    shown = (
        F.when(F.col("status") == "out_of_scope", F.col("scope.reply"))
        .when(F.col("status") == "conflict", disagreement)
        .when(F.col("status") == "missing", missing)
        .otherwise(F.coalesce("contact_answer", evidence.clean_answer("answer")))
    )
    grounded = evidence.ground_sources(
        rows.select("query_id", "question", F.coalesce("answer", F.lit("")).alias("answer"), "status"), usable
    ).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("source_pos", "source"))), lambda s: s["source"]).alias("sources")
    )
    rows = rows.withColumn("answer", shown).join(grounded, "query_id", "left")
    if corpus.links is not None:
        step = evidence.contact_for(state.filter("scope.relevant"), corpus.links).select(
            "query_id", F.struct("label", "url", "contact").alias("next_action")
        )
        rows = rows.join(step, "query_id", "left")
    else:
        rows = rows.withColumn("next_action", F.lit(None).cast("struct<label:string,url:string,contact:string>"))
    off = F.col("status") == "out_of_scope"
    return rows.select(
        "query_id", "question", "status", "answer",
        F.when(F.col("status").isin("supported"), F.col("sources")).alias("sources"),
        F.when(F.col("status") == "conflict", F.col("conflicts")).alias("conflicts"), "next_action",
        F.when(off, "high").when(F.col("status") == "missing", "low").otherwise(F.col("level")).alias("confidence"),
        F.when(off, 0.9).when(F.col("status") == "missing", 0.2).when(F.col("status") == "conflict", 0.4)
        .otherwise(F.col("score")).alias("confidence_score"),
        "language", "intent", "answer_mode", "institution",
    )
