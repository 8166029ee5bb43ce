"""Text functions over the documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import joined, query
from quaero.functions import text as T
from quaero.operators import chunking, lexical
from quaero.values import words


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


FOLD = "strip_accents(lower({c}))"
TOKENS = (
    "list_distinct(list_filter(regexp_extract_all(" + FOLD + ", '[a-z0-9ёа-я]{{3,}}'), "
    "lambda w: w NOT IN (" + quoted(words.STOP_WORDS) + ")))"
)
WORD_COUNT = "len(regexp_extract_all({c}, '\\S+'))"
APPROX = "greatest(1, floor(" + WORD_COUNT + " / 0.75))::BIGINT"


def tokens_sql(c: str) -> str:
    return TOKENS.format(c=c)


def overlap_sql(q: str, t: str) -> str:
    """Share of the token list ``q`` found in the token list ``t``."""
    return (
        f"CASE WHEN len({q}) > 0 AND len({t}) > 0 THEN len(list_intersect({q}, {t})) / len({q})::DOUBLE ELSE 0.0 END"
    )


@query("text_fold", f"SELECT doc_id, md5({FOLD.format(c='text')}) AS folded FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.fold("text")).alias("folded"))


@query("text_tokens", f"""
SELECT doc_id, len(x)::BIGINT AS n, md5(array_to_string(list_sort(x), ' ')) AS tokens
FROM (SELECT doc_id, {tokens_sql('text')} AS x FROM documents)""")
def _(t):
    found = t("documents").select("doc_id", T.tokens("text").alias("x"))
    return found.select(
        "doc_id", F.size("x").cast("long").alias("n"), F.md5(joined(F.array_sort("x"), " ")).alias("tokens")
    )


@query("question_overlap", f"""
WITH turns AS (SELECT conv_id, turn, {tokens_sql('text')} AS x FROM conversations),
 q AS (SELECT conv_id, turn, x FROM turns)
SELECT q.conv_id, q.turn, round({overlap_sql('q.x', 'a.x')}, 6) AS overlap
FROM q JOIN turns a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1""")
def _(t):
    turns = t("conversations").select("conv_id", "turn", T.tokens("text").alias("x"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return turns.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(T.share_of(F.col("x"), F.col("y")), 6).alias("overlap")
    )


@query("content_hash", r"""
SELECT doc_id, sha256(regexp_replace(trim(text, E' \t\n\r'), '\s+', ' ', 'g')) AS content_hash FROM documents""")
def _(t):
    return t("documents").select("doc_id", T.content_hash("text").alias("content_hash"))


@query("approx_token_counts", f"""
SELECT doc_id, {WORD_COUNT.format(c='text')}::BIGINT AS words, {APPROX.format(c='text')} AS tokens FROM documents""")
def _(t):
    return t("documents").select(
        "doc_id", T.word_count("text").cast("long").alias("words"), T.approx_tokens("text").cast("long").alias("tokens")
    )


@query("majority_language", r"""
SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]'))
  > len(list_filter(regexp_extract_all(text, '\p{L}'), lambda c: NOT regexp_matches(c, '[\x{0400}-\x{04FF}]')))
  THEN 'ru' ELSE 'ro' END AS language FROM documents""")
def _(t):
    return t("documents").select("doc_id", T.majority_language("text").alias("language"))


LANGUAGE = f"""
w AS (SELECT *, list_transform(regexp_extract_all(q, '[A-Za-zăâîșțĂÂÎȘȚ]+'), lambda x: lower(x)) AS ws FROM asked),
c AS (SELECT *, len(ws)::DOUBLE AS n,
  len(list_filter(ws, lambda x: x IN ({quoted(words.ENGLISH_HINTS)}))) AS en,
  len(list_filter(ws, lambda x: x IN ({quoted(words.ROMANIAN_HINTS)})))
    + CASE WHEN regexp_matches(q, '[ăâîșțĂÂÎȘȚ]') THEN 2 ELSE 0 END AS ro FROM w),
k AS (SELECT *, CASE WHEN q = '' THEN 'ro' WHEN regexp_matches(q, '[\\x{{0400}}-\\x{{04FF}}]') THEN 'ru' WHEN n = 0 THEN 'ro'
    WHEN en >= 2 AND en > ro THEN 'en' WHEN ro >= 1 AND ro >= en THEN 'ro'
    WHEN en = 1 AND ro = 0 AND n <= 6 THEN 'en' ELSE 'ro' END AS lang,
  CASE WHEN q = '' THEN 0.0 WHEN regexp_matches(q, '[\\x{{0400}}-\\x{{04FF}}]') THEN 0.95 WHEN n = 0 THEN 0.2
    WHEN en >= 2 AND en > ro THEN least(0.95, 0.45 + en / n) WHEN ro >= 1 AND ro >= en THEN least(0.95, 0.4 + ro / n)
    WHEN en = 1 AND ro = 0 AND n <= 6 THEN 0.55 ELSE 0.35 END AS conf FROM c)"""


@query("question_language", f"""
WITH asked AS (SELECT conv_id, turn, trim(text, E' \\t\\n\\r') AS q FROM conversations), {LANGUAGE}
SELECT conv_id, turn, lang AS language, round(conf, 6) AS confidence FROM k""")
def _(t):
    found = t("conversations").select("conv_id", "turn", T.question_language("text").alias("x"))
    return found.select("conv_id", "turn", "x.language", F.round("x.confidence", 6).alias("confidence"))


@query("answer_language", f"""
WITH asked AS (SELECT conv_id, turn, trim(text, E' \\t\\n\\r') AS q,
   CASE conv_id % 4 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' WHEN 2 THEN 'ro' END AS ui FROM conversations), {LANGUAGE}
SELECT conv_id, turn, CASE WHEN conf >= 0.55 THEN lang ELSE coalesce(ui, lang) END AS answer_language,
  CASE WHEN conf >= 0.55 THEN 'question' WHEN ui IS NOT NULL THEN 'ui_hint' ELSE 'question_weak' END AS source FROM k""")
def _(t):
    ui = F.when(F.col("conv_id") % 4 == 0, "RU ").when(F.col("conv_id") % 4 == 1, "en").when(
        F.col("conv_id") % 4 == 2, "ro").otherwise("de")
    found = t("conversations").select("conv_id", "turn", T.answer_language("text", ui).alias("x"))
    return found.select("conv_id", "turn", "x.answer_language", "x.source")


# The text's paragraphs are its own; sentence ends are marked first because RE2 has no look-behind.
UNITS = r"""
paras AS (SELECT doc_id, p.x AS para, p.i AS pi FROM (SELECT doc_id,
    list_filter(list_transform(regexp_split_to_array(trim(replace(replace(text, E'\r\n', E'\n'), E'\r', E'\n'), E' \t\n'), '\n{2,}'),
      lambda s: trim(s, E' \t\n')), lambda s: s <> '') AS ps FROM documents) , unnest(list_transform(range(1, len(ps) + 1), lambda i: {'i': i, 'x': ps[i]})) AS u(p)),
sents AS (SELECT doc_id, pi, CASE WHEN greatest(1, floor(len(regexp_extract_all(para, '\S+')) / 0.75)) <= 650 THEN [para]
    ELSE list_filter(list_transform(string_split(regexp_replace(para, '([.!?…])\s+', E'\\1\x1e', 'g'), E'\x1e'), lambda s: trim(s, E' \t\n')), lambda s: s <> '') END AS us FROM paras),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, k.i) - 1 AS idx, k.x AS unit
    FROM sents, unnest(list_transform(range(1, len(us) + 1), lambda i: {'i': i, 'x': us[i]})) AS v(k)),
sized AS (SELECT doc_id, idx, unit, greatest(1, floor(len(regexp_extract_all(unit, '\S+')) / 0.75))::BIGINT AS n FROM units)"""


@query("chunk_units", f"""
WITH {UNITS} SELECT doc_id, count(*)::BIGINT AS units, sum(n)::BIGINT AS tokens, md5(string_agg(unit, '|' ORDER BY idx)) AS units_md5
FROM sized GROUP BY doc_id""")
def _(t):
    units = t("documents").select("doc_id", chunking.units("text").alias("u"))
    total = F.aggregate("u", F.lit(0).cast("long"), lambda acc, u: acc + T.approx_tokens(u))
    return units.filter(F.size("u") > 0).select(
        "doc_id", F.size("u").cast("long").alias("units"), total.alias("tokens"), F.md5(joined("u")).alias("units_md5")
    )


@query("chunk_packing", f"""
WITH RECURSIVE {UNITS},
sums AS (SELECT doc_id, idx, sum(n) OVER (PARTITION BY doc_id ORDER BY idx) AS upto, n FROM sized),
lists AS (SELECT doc_id, [0] || list(upto::BIGINT ORDER BY idx) AS p, list(unit ORDER BY idx) AS us FROM sums JOIN sized USING (doc_id, idx) GROUP BY doc_id),
packed AS (
  SELECT doc_id, 0::BIGINT AS no, 0::BIGINT AS first, greatest(1, len(list_filter(p, lambda x: x <= 650)) - 1)::BIGINT AS past FROM lists
  UNION ALL
  SELECT k.doc_id, k.no + 1, nf, greatest(k.past + 1, len(list_filter(l.p, lambda x: x - l.p[nf + 1] <= 650)) - 1)::BIGINT
  FROM (SELECT packed.*, least(packed.past - 1, greatest(packed.first, len(list_filter(l0.p, lambda x: l0.p[packed.past + 1] - x > 100))))::BIGINT AS nf
        FROM packed JOIN lists l0 USING (doc_id)) k JOIN lists l USING (doc_id) WHERE k.past < len(l.us))
SELECT doc_id, no AS chunk_no, (past - first)::BIGINT AS units,
  greatest(1, floor(len(regexp_extract_all(array_to_string(us[first + 1:past], E'\\n\\n'), '\\S+')) / 0.75))::BIGINT AS token_count,
  md5(trim(array_to_string(us[first + 1:past], E'\\n\\n'), E' \\t\\n')) AS content_md5
FROM packed JOIN lists USING (doc_id)""")
def _(t):
    docs = t("documents").select(F.col("doc_id"), F.col("text").alias("content"))
    units = docs.select("doc_id", chunking.units("content").alias("u")).filter(F.size("u") > 0)
    cut = units.select("doc_id", F.posexplode(chunking.bounds(F.transform("u", T.approx_tokens))).alias("chunk_no", "b"))
    sizes = cut.select("doc_id", F.col("chunk_no").cast("long"), (F.col("b.past") - F.col("b.first")).cast("long").alias("units"))
    chunks = chunking.chunk_documents(docs, keep=("doc_id",)).select(
        "doc_id", F.col("chunk_no").cast("long"), F.col("token_count").cast("long"), F.md5("content").alias("content_md5")
    )
    return sizes.join(chunks, ["doc_id", "chunk_no"])


@query("chunk_pages")
def _(t):
    paged = t("documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n").alias("pages"))
    return chunking.chunk_pages(paged).groupBy("document_id").agg(
        F.max("page").alias("pages"), F.count("*").alias("chunks"), F.max("token_count").alias("longest")
    )


@query("document_embedding")
def _(t):
    made = chunking.embed(t("documents").select("doc_id", "text"), "text")
    from quaero.functions import vectors as V

    return made.select("doc_id", V.dims(F.col("embedding")).alias("dims"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("query_embedding")
def _(t):
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    from quaero.functions import vectors as V

    return chunking.embed_queries(asked).select(
        "query_id", V.dims(F.col("embedding")).alias("dims"), F.round(V.norm(F.col("embedding")), 4).alias("norm")
    )


WORDS = "regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}]+')"


@query("postings_frequency", f"""
WITH w AS (SELECT doc_id, unnest({WORDS.format(c='text')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM w GROUP BY term""")
def _(t):
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return lexical.postings(chunks).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("posting_weights", f"""
WITH s AS (SELECT doc_id, {WORDS.format(c='source')} AS a, {WORDS.format(c='text')} AS b FROM documents),
p AS (SELECT doc_id, unnest(list_concat(a, b)) AS term, unnest(range(1, len(a) + len(b) + 1)) AS pos, len(a) AS na FROM s)
SELECT doc_id AS chunk_id, term, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos,
  min(CASE WHEN pos <= na THEN 'A' ELSE 'B' END) AS best_weight FROM p GROUP BY ALL""")
def _(t):
    chunks = t("documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("section"), F.col("text").alias("content")
    )
    return lexical.word_positions(chunks).groupBy("chunk_id", "term").agg(
        F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"),
        F.min("weight").alias("best_weight"),
    )
