"""Question analysis: real turns against SQL patterns, and worded examples against known results."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import joined, query
from checks.sqlre import like, sql_text
from checks.text import FOLD
from quaero.operators import conversations, facts, questions
from quaero.values import patterns, replies

# Every customer asks one of these. Known results: intent, lists, present, job, mode, language,
# institution, sector, relevant, reason, what is compared.
EXAMPLES = [
    ("În cât timp primesc autorizația pentru un gard nou?", "deadline", False, False, False, "deadline", "ro", None, None, True, "classifier_unavailable", "duration_days"),
    ("La ce telefon răspunde primăria?", "contact", False, False, False, "contact", "ro", None, None, True, "named_authority_and_service", None),
    ("Există vreun concurs anunțat acum?", "concurs", True, True, True, "list", "ro", None, None, True, "classifier_unavailable", None),
    ("dar posturi vacante la sectorul Botanica?", "concurs", False, True, True, "list", "ro", "botanica", "botanica", True, "sector_job_question", None),
    ("What documents are required to build a garage?", "general", False, False, False, "fact", "en", None, None, True, "classifier_unavailable", None),
    ("Cum te cheamă?", "general", False, False, False, "howto", "ro", None, None, False, "identity", None),
    ("Vremea la Oslo duminică seara", "general", False, False, False, "fact", "ro", None, None, False, "clear_offtopic", None),
    ("Есть конкурсы на службу сейчас?", "concurs", False, True, True, "list", "ru", None, None, True, "classifier_unavailable", None),
    ("Cum ridic certificatul de urbanism de la primărie?", "autorizatie", False, False, False, "howto", "ro", "dgaurf", None, True, "named_authority_and_service", None),
    ("Ce taxă are un certificat de urbanism?", "autorizatie", False, False, False, "fact", "ro", "dgaurf", None, True, "classifier_unavailable", "fee"),
    ("Adresa și telefonul preturii Râșcani", "contact", False, False, False, "contact", "ro", "rascani", "rascani", True, "named_authority_and_service", None),
    ("Ce posturi vacante are acum sectorul Râșcani?", "concurs", True, True, True, "list", "ro", "rascani", "rascani", True, "sector_job_question", None),
    ("Bună ziua!", "general", False, False, False, "fact", "ro", None, None, False, "clear_offtopic", None),
    ("How long until a building permit is issued?", "autorizatie", False, False, False, "howto", "en", None, None, True, "classifier_unavailable", "duration_days"),
    ("Autorizația mea e pierdută, pretura Centru o reface?", "autorizatie", False, False, False, "fact", "ro", "centru", "centru", True, "named_authority_and_service", None),
    ("Sesizare: felinar stins la Buiucani", "general", False, False, False, "fact", "ro", "buiucani", "buiucani", True, "classifier_unavailable", None),
]
NAMES = "question intent lists present job mode language institution sector relevant reason compared".split()


def cell(v) -> str:
    if v is None:
        return "NULL"
    return str(v).lower() if isinstance(v, bool) else f"'{sql_text(str(v))}'"


def examples_sql(extra: dict[str, list] | None = None) -> str:
    extra = extra or {}
    rows = ", ".join(
        "(" + ", ".join([str(i), *map(cell, r), *[cell(v[i]) for v in extra.values()]]) + ")" for i, r in enumerate(EXAMPLES)
    )
    return (
        f"known(k, {', '.join([*NAMES, *extra])}) AS (VALUES {rows}), "
        f"asked AS (SELECT c_custkey AS query_id, known.* FROM customer JOIN known ON k = c_custkey % {len(EXAMPLES)})"
    )


def asked(t):
    wording = F.element_at(F.array(*[F.lit(r[0]) for r in EXAMPLES]), (F.col("c_custkey") % len(EXAMPLES) + 1).cast("int"))
    return t("customer").select(F.col("c_custkey").alias("query_id"), wording.alias("question"))


@query("question_metadata", f"""
WITH {examples_sql()} SELECT query_id, intent, lists OR mode = 'list' AS wants_list, present AS wants_current, job AS is_job, mode AS answer_mode, language FROM asked""")
def _(t):
    return questions.analyze(asked(t)).select(
        "query_id", "intent", "wants_list", "wants_current", "is_job", "answer_mode", "language"
    )


@query("question_scope", f"""
WITH {examples_sql()} SELECT query_id, relevant, reason, CASE WHEN reason = 'classifier_unavailable' THEN 'fallback' ELSE 'heuristic' END AS source,
 CASE WHEN reason = 'identity' THEN 'identity' WHEN relevant THEN 'municipal' ELSE 'offtopic' END AS kind, NOT relevant AS has_reply FROM asked""")
def _(t):
    judged = questions.scope(questions.analyze(asked(t)))
    return judged.select(
        "query_id", "scope.relevant", "scope.reason", "scope.source", "scope.kind", F.col("scope.reply").isNotNull().alias("has_reply")
    )


@query("question_scope_classified", f"""
WITH {examples_sql()} SELECT query_id, CASE WHEN reason <> 'classifier_unavailable' THEN relevant WHEN query_id % 3 = 0 THEN false ELSE true END AS relevant,
 CASE WHEN reason <> 'classifier_unavailable' THEN 'heuristic' WHEN query_id % 3 = 2 THEN 'fallback' ELSE 'model' END AS source FROM asked""")
def _(t):
    """A classifier that judges two of three questions and fails on the third."""
    part = F.col("query_id") % 3
    judge = lambda q: F.when(
        part != 2, F.struct((part != 0).alias("relevant"), F.lit("by model").alias("reason"), F.lit("model").alias("source"))
    )
    return questions.scope(questions.analyze(asked(t)), classifier=judge).select("query_id", "scope.relevant", "scope.source")


REPLIES_SQL = "CASE language WHEN 'ru' THEN '{0}' WHEN 'en' THEN '{1}' ELSE '{2}' END"
IDENTITY, OFF_TOPIC = ([sql_text(said[x].replace("{assistant}", "Bot")) for x in ("ru", "en", "ro")] for said in (replies.IDENTITY, replies.OFF_TOPIC))


@query("canned_replies", f"""
WITH {examples_sql()} SELECT query_id, CASE WHEN reason = 'identity' THEN {REPLIES_SQL.format(*IDENTITY)} ELSE {REPLIES_SQL.format(*OFF_TOPIC)} END AS reply FROM asked WHERE NOT relevant""")
def _(t):
    judged = questions.scope(questions.analyze(asked(t)), assistant="Bot").filter("not scope.relevant")
    return judged.select("query_id", F.col("scope.reply").alias("reply"))


@query("question_institution", f"WITH {examples_sql()} SELECT query_id, institution, sector, compared FROM asked")
def _(t):
    return asked(t).select(
        "query_id", questions.institution("question").alias("institution"),
        facts.sector_in_question("question").alias("sector"), facts.claim_field("question").alias("compared"),
    )


VACANCIES = "concurs pentru ocuparea funcției publice vacante anunț dosar specialist funcții publice vacante AVIZ CONCURS "
SEARCHED = [r[0] for r in EXAMPLES]
SEARCHED[1] = "date de contact telefon email adresă La ce telefon răspunde primăria?"
SEARCHED[2] = VACANCIES + "vreun concurs anunțat"
SEARCHED[3] = "Pretura sectorului Botanica concurs funcții vacante"
SEARCHED[7] = VACANCIES + "конкурсы службу сейчас"
SEARCHED[10] = "date de contact telefon email adresă Pretura sectorului Râșcani rascani pretura"
SEARCHED[11] = "Pretura sectorului Râșcani concurs funcții vacante"


@query("search_wording", f"WITH {examples_sql({'searched': SEARCHED})} SELECT query_id, searched FROM asked")
def _(t):
    return asked(t).select(
        "query_id", questions.search_query("question", questions.intent("question"), questions.institution("question")).alias("searched")
    )


ALTERNATIVES = [
    "cât timp primesc autorizația gard nou",
    "contact email|telefon răspunde primăria",
    "funcție vacantă functii vacante|există vreun concurs anunțat acum",
    "pretura buiucanibotanica|Pretura sectorului Botanica|dar posturi vacante sectorul botanica",
    "documents required build garage",
    "cum cheamă",
    "vremea oslo duminică seara",
    "есть конкурсы службу сейчас",
    "dgaurf arhitecturădgaurf|DGAURF|cum ridic certificatul urbanism primărie",
    "dgaurf arhitecturădgaurf|DGAURF|taxă certificat urbanism",
    "contact emailrascani|pretura sectorrascani|Pretura sectorului Râșcani telefon email adresă|contact rascani pretura",
    "pretura botanicarascani|Pretura sectorului Râșcani|posturi vacante acum sectorul râșcani",
    "bună ziua",
    "autorizație autorizatie|long until building permit issued",
    "sector botanicacentru|Pretura sectorului Centru|autorizația mea pierdută pretura centru reface",
    "pretura sectorbuiucani|petiție petitiebuiucani|Pretura sectorului Buiucani|sesizare felinar stins buiucani",
]


@query("alternative_wordings", f"WITH {examples_sql({'others': ALTERNATIVES})} SELECT query_id, others FROM asked")
def _(t):
    own = questions.alternative_queries("question", questions.intent("question"), questions.institution("question"))
    return asked(t).select("query_id", joined(own).alias("others"))


@query("wording_list", f"""
WITH {examples_sql({'others': ALTERNATIVES})}, l AS (SELECT query_id, string_split(others, '|') AS o FROM asked)
SELECT query_id, array_to_string(list_concat(o, ['altceva', 'a treia'])[1:5], '|') AS wordings FROM l""")
def _(t):
    own = questions.alternative_queries("question", questions.intent("question"), questions.institution("question"))
    suggested = F.array(F.upper(F.get(own, F.lit(0))), F.lit("altceva"), F.lit("Altceva"), F.lit(""), F.lit("a treia"))
    return asked(t).select("query_id", joined(questions.query_list(own, suggested)).alias("wordings"))


TOPICS = [
    "primesc|autorizația", "telefon|răspunde|primăria", "Există|vreun|concurs|anunțat", "posturi|vacante|sectorul|Botanica",
    "documents|required|build|garage", "cheamă", "Vremea|duminică|seara", "конкурсы|службу|сейчас", "ridic|certificatul|urbanism|primărie",
    "certificat|urbanism", "Adresa|telefonul|preturii|Râșcani", "posturi|vacante|sectorul|Râșcani", "", "until|building|permit|issued",
    "Autorizația|pierdută|pretura|Centru|reface", "Sesizare|felinar|stins|Buiucani",
]

@query("topic_terms", f"WITH {examples_sql({'topics': TOPICS})} SELECT query_id, topics FROM asked")
def _(t):
    return asked(t).select("query_id", joined(questions.topic_terms("question")).alias("topics"))


@query("question_for_search", f"""
WITH {examples_sql()} SELECT query_id, intent, mode AS answer_mode, 2026::BIGINT AS year_now, 'https://x.md/a?b=1' AS urls FROM asked""")
def _(t):
    rows = asked(t).withColumn("question", F.concat("question", F.lit(" (https://x.md/a?b=1)")))
    return questions.analyze_for_search(rows, 2026).select(
        "query_id", "intent", "answer_mode", F.col("year_now").cast("long"), joined("urls").alias("urls")
    )


@query("quoted_phrases", """SELECT c_custkey AS query_id, c_name || '” sau «' || c_mktsegment || '» și "ab' AS phrases FROM customer""")
def _(t):
    """A phrase runs to the last closing quote within eighty characters."""
    text = F.concat(F.lit("caut „"), "c_name", F.lit("” sau «"), "c_mktsegment", F.lit("» și \"ab\""))
    return t("customer").select(F.col("c_custkey").alias("query_id"), joined(questions.quoted_phrases(text)).alias("phrases"))


# --- real turns --------------------------------------------------------------------------

WORDED = {
    "deadline": patterns.DEADLINE_WORDS, "contact": patterns.CONTACT_WORDS, "permit": patterns.PERMIT_WORDS,
    "job": patterns.JOB_WORDS, "list": patterns.LIST_WORDS, "now": patterns.CURRENT_WORDS, "howto": patterns.HOWTO_WORDS,
}
FLAGS = ", ".join(f"{like('text', p)} AS f_{n}" for n, p in WORDED.items())


@query("turn_intents", f"""
WITH f AS (SELECT conv_id, turn, {FLAGS} FROM conversations),
i AS (SELECT *, CASE WHEN f_deadline THEN 'deadline' WHEN f_contact THEN 'contact' WHEN f_permit THEN 'autorizatie' WHEN f_job THEN 'concurs' ELSE 'general' END AS intent FROM f)
SELECT conv_id, turn, intent, f_list AS wants_list, f_now AS wants_current, CASE WHEN intent IN ('contact', 'deadline') THEN intent
  WHEN f_list OR intent = 'concurs' THEN 'list' WHEN f_howto THEN 'howto' ELSE 'fact' END AS answer_mode FROM i""")
def _(t):
    rows = t("conversations").withColumn("intent", questions.intent("text"))
    return rows.select(
        "conv_id", "turn", "intent", questions.wants_list("text").alias("wants_list"),
        questions.wants_current("text").alias("wants_current"), questions.answer_mode("text", F.col("intent")).alias("answer_mode"),
    )


OFF = patterns.OFF_TOPIC_PHRASES.replace(r"vremea\s+la\s+(?!chi)|", "")


@query("turn_scope_predicates", f"""
WITH s AS (SELECT conv_id, turn, text, trim(text, E' \\t\\n\\r') AS q FROM conversations)
SELECT conv_id, turn, {like('text', patterns.CITY_HINTS)} AS city, {like('text', patterns.AUTHORITY_WORDS)} AND {like('text', patterns.PUBLIC_SERVICE_WORDS)} AS explicit,
 {like('text', patterns.CIVIC_TOPIC_WORDS)} OR ({like('text', patterns.BUILDING_WORDS)} AND {like('text', patterns.PAPERWORK_WORDS)}) AS plausible,
 len(q) < 2 OR {like('q', patterns.IDENTITY_PHRASES)} OR {like('q', OFF)} OR (len({FOLD.format(c='q')}) < 18 AND NOT {like('q', patterns.CITY_HINTS)}) AS off_topic,
 {like('text', patterns.GATE_DEADLINE_WORDS)} AS about_deadline FROM s""")
def _(t):
    return t("conversations").select(
        "conv_id", "turn", questions.names_city_matter("text").alias("city"),
        questions.names_authority_and_service("text").alias("explicit"), questions.is_plausibly_civic("text").alias("plausible"),
        questions.is_clearly_off_topic("text").alias("off_topic"), questions.is_deadline_question("text").alias("about_deadline"),
    )


def messages(t):
    return t("conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")
    )


@query("previous_questions", """
SELECT conv_id AS session_id, turn, md5(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS previous FROM conversations WHERE role = 'user'""")
def _(t):
    turns = conversations.with_previous_question(messages(t), width=3)
    return turns.select("session_id", "turn", F.md5("previous").alias("previous"))


@query("answered_pairs", """
WITH o AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS r, lag(text) OVER w AS q FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS session_id, turn, md5(q) AS question, md5(text) AS answer FROM o WHERE role = 'assistant' AND r = 'user'""")
def _(t):
    found = conversations.answered_pairs(messages(t), width=3)
    return found.select("session_id", "turn", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


# Orders as turns of their customer's session: an opening about jobs, then short follow-ups.
FOLLOW_UPS = ["Dar în sectorul Centru?", "What about Buiucani?", "Dar unde se depune dosarul?", "Ce posturi vacante are primăria acum?", "Any job opening there?"]


@query("follow_ups", f"""
WITH m AS (SELECT o_custkey AS session_id, o_orderkey AS turn, o_orderkey % 5 AS k FROM orders),
p AS (SELECT *, lag(k) OVER (PARTITION BY session_id ORDER BY turn) AS pk FROM m)
SELECT session_id, turn, CASE WHEN k = 0 AND pk = 3 THEN 'Există concursuri publice deschise acum în sectorul Centru?' WHEN k = 0 AND pk = 4 THEN 'Există concursuri publice în sectorul Centru?'
  WHEN k = 1 AND pk = 3 THEN 'What job openings are available now in Buiucani sector?' WHEN k = 1 AND pk = 4 THEN 'What job openings are available in Buiucani sector?'
  ELSE ['{"', '".join(FOLLOW_UPS)}'][k + 1] END AS question FROM p""")
def _(t):
    text = F.element_at(F.array(*[F.lit(x) for x in FOLLOW_UPS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = t("orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("turn"), F.lit("user").alias("role"), text.alias("content")
    )
    return conversations.contextualize(rows).select("session_id", "turn", "question")


# Events as a chat: each is a question about its type by its user, answered a second later.
CHAT_SQL = """
chat AS (SELECT event_id, user_id AS session_id, event_type, ts, value >= 5 AS sourced FROM events),
prior AS (SELECT a.event_id AS query_id, a.session_id, max(b.event_id) AS prior_id FROM chat a JOIN chat b
  ON b.session_id = a.session_id AND b.event_type = a.event_type AND b.ts + INTERVAL 1 SECOND <= a.ts AND b.sourced GROUP BY ALL)"""


def chat(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    question = F.concat(F.lit("Ce acte cer pentru "), "event_type", F.lit(" la sediu?"))
    sourced = F.col("value") >= 5
    user = e.select(
        F.col("user_id").alias("session_id"), (F.col("event_id") * 2).alias("turn"), F.lit("user").alias("role"), question.alias("content"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("sources_json"), F.col("ts").alias("created_at"),
    )
    reply = e.select(
        F.col("user_id").alias("session_id"), (F.col("event_id") * 2 + 1).alias("turn"), F.lit("assistant").alias("role"),
        F.concat(F.lit("Cererea [1] "), F.col("event_id").cast("string")).alias("content"),
        F.when(sourced, "supported").otherwise("missing").alias("status"),
        F.when(F.col("event_id") % 4 == 0, F.lit('[{"document":"d","url":""}]')).otherwise(F.lit('[{"document":"d","url":"https://x.md"}]')).alias("sources_json"),
        (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("created_at"),
    )
    asks = e.select(
        F.col("event_id").alias("query_id"), F.col("user_id").alias("session_id"),
        F.upper(question).alias("question"), F.col("ts").alias("asked_at"),
    )
    return user.unionByName(reply), asks


@query("prior_answers", f"""
WITH {CHAT_SQL} SELECT query_id, p.session_id, prior_id * 2 + 1 AS turn FROM prior p JOIN chat a ON a.event_id = query_id JOIN chat b ON b.event_id = prior_id
WHERE a.ts - (b.ts + INTERVAL 1 SECOND) <= INTERVAL 24 HOUR""")
def _(t):
    return conversations.prior_answers(*chat(t)).select("query_id", "session_id", "turn")


@query("reused_responses", f"""
WITH {CHAT_SQL} SELECT query_id, 'Cererea [1] ' || prior_id AS answer, 'ro' AS language FROM prior p JOIN chat a ON a.event_id = query_id JOIN chat b ON b.event_id = prior_id
WHERE a.ts - (b.ts + INTERVAL 1 SECOND) <= INTERVAL 24 HOUR AND prior_id % 4 <> 0""")
def _(t):
    found = conversations.reused_responses(conversations.prior_answers(*chat(t)))
    return found.select("query_id", "answer", "language")


@query("session_list", """
WITH s AS (SELECT conv_id, arg_min(substr(text, 1, 80), turn) FILTER (WHERE role = 'user') AS title, TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 MINUTE + max(turn) * INTERVAL 1 SECOND AS upd FROM conversations GROUP BY conv_id)
SELECT conv_id AS session_id, md5(title) AS title, epoch_us(upd)::BIGINT AS updated_us FROM s ORDER BY upd DESC, conv_id DESC LIMIT 100""")
def _(t):
    return conversations.session_list(touched(t)).select(
        "session_id", F.md5("title").alias("title"), F.unix_micros("updated_at").alias("updated_us")
    )


def touched(t):
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    at = F.timestamp_micros(F.unix_micros(start) + (F.col("conv_id") * 60 + F.col("turn")) * 1_000_000)
    rows = messages(t).join(
        t("conversations").select(F.col("conv_id").alias("session_id"), "turn", at.alias("created_at"), (F.col("conv_id") % 7).alias("user_id")),
        ["session_id", "turn"],
    )
    old = t("conversations").select(F.col("conv_id").alias("session_id")).distinct().filter("session_id % 2 = 0").select(
        "session_id", (F.col("session_id") % 7).alias("user_id"), F.lit("Chat nou").alias("title"), start.alias("updated_at")
    )
    return conversations.touch_sessions(old, rows)


@query("session_touch", """
SELECT conv_id AS session_id, conv_id % 7 AS user_id, md5(coalesce(arg_min(substr(text, 1, 80), turn) FILTER (WHERE role = 'user'), 'Chat nou')) AS title FROM conversations GROUP BY conv_id""")
def _(t):
    return touched(t).select("session_id", "user_id", F.md5("title").alias("title"))


@query("session_messages", """
SELECT user_id AS session_id, event_id * 2 + 1 AS turn, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'https://x.md' END AS url FROM events WHERE user_id % 2 = 0""")
def _(t):
    rows = chat(t)[0].filter("role = 'assistant'")
    own = t("events").filter("user_id % 2 = 0").select(F.col("user_id").alias("session_id"))
    shown = conversations.session_messages(rows, own)
    return shown.select("session_id", "turn", F.get("sources", F.lit(0))["url"].alias("url"))

