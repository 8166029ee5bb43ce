"""Question analysis: intent, mode, scope, topics, rewriting. One row per question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators.facts import sector_in_question
from quaero.values import contacts, patterns, replies, words

Classifier = Callable[[Column], Column]


def _text(q: Column | str) -> Column:
    return T.text_or_empty(q)


def intent(q: Column | str) -> Column:
    """The first of deadline, contact, autorizatie and concurs that the question names."""
    return (
        F.when(T.matches(q, patterns.DEADLINE_WORDS), "deadline")
        .when(T.matches(q, patterns.CONTACT_WORDS), "contact")
        .when(T.matches(q, patterns.PERMIT_WORDS), "autorizatie")
        .when(T.matches(q, patterns.JOB_WORDS), "concurs")
        .otherwise("general")
    )


def wants_list(q: Column | str) -> Column:
    return T.matches(q, patterns.LIST_WORDS)


def wants_current(q: Column | str) -> Column:
    return T.matches(q, patterns.CURRENT_WORDS)


def is_job_question(q: Column | str) -> Column:
    """A question with the intent ``concurs`` always has a job word."""
    return T.matches(q, patterns.JOB_WORDS)


def answer_mode(q: Column | str, known_intent: Column) -> Column:
    return (
        F.when(known_intent.isin("contact", "deadline"), known_intent)
        .when(wants_list(q) | (known_intent == "concurs"), "list")
        .when(T.matches(q, patterns.HOWTO_WORDS), "howto")
        .otherwise("fact")
    )


def topic_terms(q: Column | str, limit: int = 8) -> Column:
    """Distinctive words in their order, then the question's tokens, longest first."""
    found = F.regexp_extract_all(
        _text(q), F.lit("[A-Za-zăâîșțĂÂÎȘŢțŢёа-яЁА-Я0-9]{4,}"), F.lit(0)
    )
    by_length = F.array_sort(
        T.tokens(q),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, -1).when(a > b, 1).otherwise(0),
    )
    pairs = F.transform(F.concat(found, by_length), lambda w: F.struct(w.alias("word"), T.fold(w).alias("bare")))
    barred = T.string_array(words.STOP_WORDS + words.WEAK_TOPICS)
    usable = F.filter(pairs, lambda p: (F.length(p["bare"]) >= 5) & ~F.array_contains(barred, p["bare"]))

    def first_of_each(found: Column) -> Column:
        bare = F.transform(found, lambda p: p["bare"])
        return F.filter(found, lambda p, i: F.array_position(bare, p["bare"]) == i + 1)

    return F.slice(F.transform(T.let(usable, first_of_each), lambda p: p["word"]), 1, limit)


def names_city_matter(q: Column | str) -> Column:
    return T.matches(q, patterns.CITY_HINTS)


def names_authority_and_service(q: Column | str) -> Column:
    return T.matches(q, patterns.AUTHORITY_WORDS) & T.matches(q, patterns.PUBLIC_SERVICE_WORDS)


def is_plausibly_civic(q: Column | str) -> Column:
    return T.matches(q, patterns.CIVIC_TOPIC_WORDS) | (
        T.matches(q, patterns.BUILDING_WORDS) & T.matches(q, patterns.PAPERWORK_WORDS)
    )


def is_identity_question(q: Column | str) -> Column:
    return T.matches(q, patterns.IDENTITY_PHRASES)


def is_clearly_off_topic(q: Column | str) -> Column:
    """Too short, about the assistant, small talk, or brief without a city matter."""
    bare = T.strip(_text(q))
    return (
        (F.length(bare) < 2)
        | is_identity_question(bare)
        | T.matches(bare, patterns.OFF_TOPIC_PHRASES)
        | ((F.length(T.fold(bare)) < 18) & ~names_city_matter(bare))
    )


def is_deadline_question(q: Column | str) -> Column:
    return T.matches(q, patterns.GATE_DEADLINE_WORDS)


def is_off_topic_for_gate(q: Column | str) -> Column:
    return T.matches(q, patterns.GATE_OFF_TOPIC_PHRASES) | is_identity_question(q) | is_clearly_off_topic(q)


def urls_in(q: Column | str) -> Column:
    return T.find_all(q, patterns.URL_IN_TEXT)


def quoted_phrases(q: Column | str) -> Column:
    return F.regexp_extract_all(_text(q), F.lit(patterns.QUOTED_PHRASE), F.lit(1))


def analyze(questions: DataFrame, question: str = "question", ui_language: str | None = None) -> DataFrame:
    """The metadata of every question as added columns."""
    q = F.col(question)
    with_intent = questions.withColumn("intent", intent(q))
    mode = answer_mode(q, F.col("intent"))
    return with_intent.withColumns(
        {
            "language_meta": T.answer_language(q, F.col(ui_language) if ui_language else None),
            "answer_mode": mode,
            "wants_list": wants_list(q) | (mode == "list"),
            "wants_current": wants_current(q),
            "topic_terms": topic_terms(q),
            "is_job": is_job_question(q),
            "looks_municipal": names_city_matter(q),
            "looks_offtopic": is_clearly_off_topic(q),
        }
    ).withColumn("language", F.col("language_meta.answer_language"))


def analyze_for_search(questions: DataFrame, year: int, question: str = "question",
                       ui_language: str | None = None) -> DataFrame:
    """``analyze`` with the wider reading of contact questions, the URLs and the current year."""
    q = F.col(question)
    contact = T.matches(q, patterns.WIDE_CONTACT_WORDS)
    return (
        analyze(questions, question, ui_language)
        .withColumn("intent", F.when(contact, "contact").otherwise(F.col("intent")))
        .withColumn("answer_mode", F.when(contact, "contact").otherwise(F.col("answer_mode")))
        .withColumn("urls", urls_in(q))
        .withColumn("year_now", F.lit(year))
    )


def _by_language(templates: dict[str, str], language: Column) -> Column:
    chosen = F.lit(templates["ro"])
    for code in ("ru", "en"):
        if code in templates:
            chosen = F.when(language == code, F.lit(templates[code])).otherwise(chosen)
    return chosen


def identity_reply(language: Column, assistant: str) -> Column:
    return F.replace(_by_language(replies.IDENTITY, language), F.lit("{assistant}"), F.lit(assistant))


def off_topic_reply(language: Column, assistant: str) -> Column:
    return F.replace(_by_language(replies.OFF_TOPIC, language), F.lit("{assistant}"), F.lit(assistant))


def scope(questions: DataFrame, question: str = "question", language: str = "language",
          classifier: Classifier | None = None, assistant: str = "Asistent") -> DataFrame:
    """Adds ``scope: struct(relevant, reason, source, kind, reply)``.

    Clear cases are settled by rule, in order. The others go to ``classifier``,
    which maps the question to ``struct(relevant boolean, reason string, source
    string)``; where it is absent or gives no verdict, plausible civic questions
    pass.
    """
    q, lang = F.col(question), F.col(language)
    judged = classifier(q) if classifier else F.lit(None).cast(
        "struct<relevant:boolean,reason:string,source:string>"
    )
    plausible = is_plausibly_civic(q)
    rule = (
        F.when(is_identity_question(q), "identity")
        .when(is_clearly_off_topic(q), "clear_offtopic")
        .when(names_authority_and_service(q), "named_authority_and_service")
        .when(is_job_question(q) & sector_in_question(q).isNotNull(), "sector_job_question")
    )
    df = questions.withColumn("_rule", rule).withColumn("_judged", F.when(F.col("_rule").isNull(), judged))
    settled = F.col("_rule").isNotNull()
    verdict = F.col("_judged.relevant")
    relevant = F.coalesce(
        F.when(settled, F.col("_rule").isin("named_authority_and_service", "sector_job_question")),
        verdict, plausible,
    )
    reason = F.coalesce(
        F.col("_rule"),
        F.when(verdict.isNotNull(), F.coalesce(F.col("_judged.reason"), F.lit(""))),
        F.nullif(F.col("_judged.reason"), F.lit("")), F.lit("classifier_unavailable"),
    )
    source = (
        F.when(settled, "heuristic")
        .when(verdict.isNotNull(), F.coalesce(F.col("_judged.source"), F.lit("llm")))
        .otherwise("fallback")
    )
    identity = F.coalesce(F.col("_rule") == "identity", F.lit(False))
    return df.withColumn(
        "scope",
        F.struct(
            relevant.alias("relevant"), reason.alias("reason"), source.alias("source"),
            F.when(identity, "identity").when(relevant, "municipal").otherwise("offtopic").alias("kind"),
            F.when(identity, identity_reply(lang, assistant))
            .when(~relevant, off_topic_reply(lang, assistant)).alias("reply"),
        ),
    ).drop("_rule", "_judged")


def institution(q: Column | str) -> Column:
    """The key of the first institution whose words all stand in the question."""
    low = F.lower(_text(q))
    found = F.lit(None).cast("string")
    for key, rules in reversed(patterns.INSTITUTION_RULES):
        hit = F.lit(True)
        for rule in rules:
            hit = hit & low.rlike("(?U)" + rule)
        found = F.when(hit, key).otherwise(found)
    return found


def institutions(spark) -> DataFrame:
    return spark.createDataFrame(contacts.INSTITUTIONS, contacts.INSTITUTION_SCHEMA)


def _institution_name(key: Column) -> Column:
    name = F.lit(None).cast("string")
    for row in contacts.INSTITUTIONS:
        name = F.when(key == row[0], F.lit(row[1])).otherwise(name)
    return name


def search_query(q: Column | str, known_intent: Column, known_institution: Column) -> Column:
    """The text to search for: rewritten for vacancies and contacts, else the question."""
    question = _text(q)
    name = _institution_name(known_institution)
    bare_stops = T.string_array(words.VACANCY_QUERY_STOPS)
    folded_stops = F.transform(bare_stops, lambda w: T.fold(w))
    extra = F.slice(
        F.filter(topic_terms(q, 6), lambda w: ~F.array_contains(folded_stops, T.fold(w))), 1, 5
    )
    vacancy = F.array_join(
        F.array_distinct(
            F.concat(
                F.when(name.isNotNull(), F.array(name)).otherwise(T.string_array([])),
                T.string_array(replies.VACANCY_SEARCH), extra,
            )
        ),
        " ",
    )
    pretura = F.when(T.matches(q, "pretur"), F.lit("pretura"))
    contact = F.concat_ws(
        " ", F.lit(replies.CONTACT_SEARCH),
        F.when(name.isNotNull(), F.concat_ws(" ", name, known_institution)).otherwise(question),
        pretura,
    )
    return (
        F.when(
            (known_intent == "concurs") & known_institution.isin(words.SECTORS),
            F.concat_ws(" ", name, F.lit(replies.VACANCY_SECTOR_SUFFIX)),
        )
        .when(known_intent == "concurs", vacancy)
        .when(known_intent == "contact", contact)
        .otherwise(question)
    )


def alternative_queries(q: Column | str, known_intent: Column, known_institution: Column,
                        limit: int = 4) -> Column:
    """Other wordings: missing synonyms per group, the institution, the keyword skeleton."""
    return T.let(
        F.lower(T.strip(_text(q))), lambda low: _alternatives(low, known_intent, known_institution, limit)
    )


def _alternatives(low: Column, known_intent: Column, known_institution: Column, limit: int) -> Column:
    key = F.coalesce(known_institution, F.lit(""))
    found = []
    for group in words.SYNONYM_GROUPS:
        present = T.contains_any(low, group)
        missing = F.slice(F.filter(T.string_array(group), lambda w: ~F.contains(low, w)), 1, 2)
        phrase = F.concat(F.array_join(missing, " "), key)
        found.append(F.when(present & (F.size(missing) > 0), F.array(phrase)).otherwise(T.string_array([])))
    name = _institution_name(known_institution)
    named = (
        F.when(
            name.isNotNull() & (known_intent == "contact"),
            F.array(F.concat(name, F.lit(" telefon email adresă")),
                    F.concat(F.lit("contact "), key, F.lit(" pretura"))),
        )
        .when(name.isNotNull(), F.array(name))
        .otherwise(T.string_array([]))
    )
    skeleton_words = F.filter(
        F.regexp_extract_all(low, F.lit("[a-zăâîșțёа-я0-9]{3,}"), F.lit(0)),
        lambda w: ~F.array_contains(T.string_array(words.SKELETON_STOPS), w),
    )
    skeleton = F.when(
        F.size(skeleton_words) > 0, F.array(F.array_join(F.slice(skeleton_words, 1, 6), " "))
    ).otherwise(T.string_array([]))
    trimmed = F.transform(F.concat(*found, named, skeleton), T.strip)
    return F.slice(distinct_ignoring_case(F.filter(trimmed, lambda w: F.lower(w) != low)), 1, limit)


def distinct_ignoring_case(texts: Column) -> Column:
    """The first of each text that differs in more than case; empty ones go."""
    def first_of_each(present: Column) -> Column:
        low = F.transform(present, F.lower)
        return F.filter(present, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)

    return T.let(F.filter(texts, lambda w: w != ""), first_of_each)


def query_list(heuristic: Column, suggested: Column | None = None, limit: int = 5) -> Column:
    """Own wordings, then outside suggestions that add a new one."""
    if suggested is None:
        return F.slice(heuristic, 1, limit)
    return F.slice(
        distinct_ignoring_case(F.concat(heuristic, F.coalesce(suggested, T.string_array([])))), 1, limit
    )


def broadening_queries(q: Column | str, known_intent: Column, known_institution: Column) -> Column:
    """Wordings for a second, wider search."""
    plain = alternative_queries(q, known_intent, F.lit(None).cast("string"))
    name = _institution_name(known_institution)
    return F.slice(
        F.when(
            (known_intent == "concurs") & known_institution.isin(words.SECTORS),
            F.array(F.concat(name, F.lit(" concurs")), F.concat(known_institution, F.lit(" funcții vacante"))),
        )
        .when(known_intent == "concurs", F.concat(T.string_array(replies.VACANCY_ALTERNATIVES), plain))
        .otherwise(plain),
        1, 6,
    )


def follow_up(q: Column | str, previous: Column) -> Column:
    """A short sector follow-up completed with the job topic of the question before it."""
    question = _text(q)
    sector = sector_in_question(question)
    name = F.initcap(sector)
    current = wants_current(previous)

    def rewritten(language: str) -> Column:
        opening, ending = replies.FOLLOW_UP[language].split("%s", 1)
        middle, end = ending.split("%s")
        now = F.when(current, F.lit(replies.FOLLOW_UP_CURRENT[language])).otherwise(F.lit(""))
        return F.concat(F.lit(opening), now, F.lit(middle), name, F.lit(end))

    short = (
        previous.isNotNull() & (previous != "") & T.matches(question, patterns.FOLLOW_UP_OPENING)
        & ~is_job_question(question) & is_job_question(previous) & sector.isNotNull()
    )
    return (
        F.when(short & T.matches(question, patterns.ENGLISH_FOLLOW_UP_OPENING), rewritten("en"))
        .when(short, rewritten("ro"))
        .otherwise(F.col(q) if isinstance(q, str) else q)
    )
