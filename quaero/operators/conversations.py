"""Chat sessions: follow-ups, answer reuse, session tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators import facts, questions
from quaero.operators.evidence import claims_missing
from quaero.operators.keyed import asof_join, carry_forward
from quaero.values import patterns

REUSE_SECONDS = 24 * 3600
DEFAULT_TITLES = ["Chat nou", "New chat"]
SOURCE = "array<struct<document:string,page:int,section:string,quote:string,url:string>>"


def reuse_key(q: Column | str) -> Column:
    return F.array_join(F.regexp_extract_all(T.fold(q), F.lit("[a-z0-9а-яё]+"), F.lit(0)), " ")


def is_reusable(q: Column | str) -> Column:
    """A question of four words or more whose answer does not depend on the day or on context."""
    return (
        (F.size(F.split(reuse_key(q), " ")) >= 4)
        & ~questions.is_job_question(q) & ~questions.wants_current(q)
        & (questions.intent(q) != "deadline") & facts.claim_field(q).isNull()
        & ~T.matches(q, patterns.TIME_BOUND_WORDS) & ~T.matches(q, patterns.REUSE_FOLLOW_UP)
    )


def with_previous_question(messages: DataFrame, width: int = 10_000) -> DataFrame:
    """User turns with ``previous``: the session's user turn before each.

    ``messages`` has (session_id, turn, role, content).
    """
    asked = messages.filter("role = 'user'")
    return carry_forward(asked, ["session_id"], "turn", F.col("content"), "previous", width=width)


def contextualize(messages: DataFrame) -> DataFrame:
    """``(session_id, turn, content, previous, question)``: follow-ups made whole."""
    turns = with_previous_question(messages)
    return turns.select(
        "session_id", "turn", "content", "previous",
        questions.follow_up(F.col("content"), F.col("previous")).alias("question"),
    )


def answered_pairs(messages: DataFrame, width: int = 10_000) -> DataFrame:
    """User turns directly followed by the assistant's, in order of turn.

    ``(session_id, turn, question, answer, status, sources_json, created_at, ...)``
    with the assistant's columns. What stands right before a message is carried
    to it, whichever turns are missing in between.
    """
    before = carry_forward(
        messages, ["session_id"], "turn", F.struct("role", "content"), "_before", width=width
    )
    return before.filter((F.col("role") == "assistant") & (F.col("_before.role") == "user")).select(
        *[c for c in messages.columns if c not in ("role", "content")],
        F.col("_before.content").alias("question"), F.col("content").alias("answer"),
    )


def prior_answers(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """The earlier answer that each question may reuse.

    ``messages`` has (session_id, turn, role, content, status, sources_json,
    created_at); ``asked`` has (query_id, session_id, question, asked_at). The
    latest sourced answer to the same words in the session counts, if it is at
    most 24 hours old. Questions and answers are laid along one time line, so a
    question asked over and over never multiplies.
    """
    pairs = answered_pairs(messages).filter(
        (F.col("status") == "supported") & (F.coalesce("sources_json", F.lit("")) != "")
        & F.col("created_at").isNotNull()
    )
    answers = pairs.select(
        "session_id", reuse_key("question").alias("reuse_key"), "turn", "answer", "sources_json", "created_at"
    )
    open_questions = asked.filter(is_reusable("question")).withColumn("reuse_key", reuse_key("question"))
    joined = asof_join(
        open_questions, answers, ["session_id", "reuse_key"], "asked_at", "created_at", "_prior"
    )
    age = F.unix_micros("asked_at") - F.unix_micros("_prior.created_at")
    return joined.filter(F.col("_prior").isNotNull() & (age <= REUSE_SECONDS * 1_000_000)).select(
        "query_id", "session_id", "question", F.col("_prior.turn").alias("turn"),
        F.col("_prior.answer").alias("answer"), F.col("_prior.sources_json").alias("sources_json"),
        F.col("_prior.created_at").alias("created_at"),
    )


def reused_responses(prior: DataFrame) -> DataFrame:
    """Prior answers that may be shown again: with a source address, and not a denial."""
    sources = F.from_json("sources_json", SOURCE)
    addressed = F.exists(sources, lambda s: F.coalesce(s["url"], F.lit("")) != "")
    return prior.withColumn("sources", sources).filter(
        F.coalesce(addressed, F.lit(False)) & ~claims_missing("answer")
    ).select(
        "query_id", F.lit("reused").alias("status"), "answer", "sources",
        F.lit("medium").alias("confidence"), F.lit(0.5).alias("confidence_score"),
        F.when(T.any_cyrillic("question"), "ru").otherwise("ro").alias("language"),
    )


def session_list(sessions: DataFrame, user_id: Column | int | None = None, limit: int = 100) -> DataFrame:
    """A user's sessions, last touched first."""
    own = sessions if user_id is None else sessions.filter(F.col("user_id") == user_id)
    return own.orderBy(F.desc("updated_at"), F.desc("session_id")).limit(limit).select(
        "session_id", "title", "updated_at"
    )


def session_messages(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages of the given sessions with their sources read from JSON."""
    return messages.join(sessions.select("session_id").distinct(), "session_id", "left_semi").withColumn(
        "sources", F.from_json("sources_json", SOURCE)
    ).drop("sources_json")


def touch_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions after a batch of messages: last touched, and titled by the first question.

    ``sessions`` has (session_id, user_id, title, updated_at), ``messages``
    (session_id, user_id, turn, role, content, created_at). Unknown sessions are added.
    """
    batch = messages.groupBy("session_id").agg(
        F.max("created_at").alias("_touched"),
        F.min_by("content", F.when(F.col("role") == "user", F.col("turn"))).alias("_first"),
        F.min("user_id").alias("_user"),
    )
    joined = sessions.join(batch, "session_id", "full_outer")
    untitled = F.col("title").isNull() | F.col("title").isin(DEFAULT_TITLES)
    title = F.when(untitled & (F.coalesce("_first", F.lit("")) != ""), F.substring("_first", 1, 80)).otherwise(
        F.coalesce("title", F.lit(DEFAULT_TITLES[0]))
    )
    return joined.select(
        "session_id", F.coalesce("user_id", "_user").alias("user_id"), title.alias("title"),
        F.greatest("updated_at", "_touched").alias("updated_at"),
    )
