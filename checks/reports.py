"""Reports over the tables: counts, coverage, feedback, latency, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import joined, query
from checks.sqlre import sql_text
from quaero.operators import costs, reports
from quaero.values import prices


@query("corpus_counts", """
SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM embeddings UNION ALL SELECT 'sources', count(*) FROM supplier
UNION ALL SELECT 'searches', count(*) FROM events UNION ALL SELECT 'users', count(*) FROM customer""")
def _(t):
    return reports.counts(
        documents=t("documents"), chunks=t("embeddings"), sources=t("supplier"), searches=t("events"), users=t("customer")
    )


@query("useful_feedback", "SELECT count(*)::BIGINT AS feedback_total, round_even(100.0 * sum(quality) / count(*), 1) AS useful_pct FROM labels")
def _(t):
    return reports.useful_feedback(t("labels").select((F.col("quality") == 1).alias("useful")))


@query("latest_crawl", "SELECT epoch_us(max(ts))::BIGINT AS last_us FROM events WHERE event_type = 'view'")
def _(t):
    at = F.when(F.col("event_type") == "view", F.col("ts").cast("timestamp"))
    return reports.latest_crawl(t("events").select(at.alias("last_crawled_at"))).select(F.unix_micros("last_crawl").alias("last_us"))


@query("approved_users", """
SELECT count(*)::BIGINT AS users_total, count(*) FILTER (WHERE c_acctbal > 5000 OR c_mktsegment IN ('MACHINERY', 'HOUSEHOLD'))::BIGINT AS users_approved FROM customer""")
def _(t):
    role = F.when(F.col("c_mktsegment") == "MACHINERY", "admin").when(F.col("c_mktsegment") == "HOUSEHOLD", "manager").otherwise("citizen")
    users = t("customer").select(F.when(F.col("c_acctbal") > 5000, True).alias("approved"), role.alias("role"))
    return reports.approved_users(users)


# Orders as changes of documents, of which those after a number are gone.
def changes(t):
    return t("orders").select(
        F.col("o_orderkey").alias("change_id"), (F.col("o_custkey") % 1200).alias("document_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("old_hash"),
        F.sha2(F.concat(F.lit("n"), F.col("o_orderkey").cast("string")), 256).alias("new_hash"), F.concat(F.lit("Content changed for "), "o_orderpriority").alias("note"),
        F.col("o_orderdate").cast("timestamp").alias("detected_at"),
    )


def documents(t):
    return t("documents").select(
        F.col("doc_id").alias("document_id"), F.split("text", "\n")[0].alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("text/html").alias("mime_type"), F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("source_id"),
    )


@query("change_feed", """
SELECT o_orderkey AS change_id, split_part(text, chr(10), 1) AS document, substr(sha256(o_orderkey::VARCHAR), 1, 12) AS old_hash FROM orders JOIN documents ON doc_id = o_custkey % 1200
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def _(t):
    return reports.change_feed(changes(t), documents(t)).select("change_id", "document", "old_hash")


@query("document_changes", """
SELECT o_custkey % 1200 AS document_id, row_number() OVER (PARTITION BY o_custkey % 1200 ORDER BY o_orderdate DESC, o_orderkey DESC)::BIGINT AS place, substr(sha256('n' || o_orderkey), 1, 10) AS new FROM orders QUALIFY place <= 5""")
def _(t):
    return reports.document_changes(changes(t)).select("document_id", F.col("place").cast("long"), "new")


@query("document_search", """
SELECT doc_id AS document_id FROM documents WHERE split_part(text, chr(10), 1) ILIKE '%the%' OR 'https://' || source || '.example.org/' || doc_id ILIKE '%the%' ORDER BY doc_id DESC LIMIT 80""")
def _(t):
    return reports.search_documents(documents(t), "THE").select("document_id")


@query("recent_documents", "SELECT doc_id AS document_id FROM documents ORDER BY doc_id DESC LIMIT 8")
def _(t):
    return reports.recent_documents(documents(t)).select("document_id")


def sources(t):
    return t("supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string")).alias("url"),
        F.concat(F.lit("P"), (F.col("s_suppkey") % 3).cast("string")).alias("priority"),
    )


@query("sources_with_counts", """
WITH n AS (SELECT regexp_extract(source, '[0-9]+')::BIGINT AS source_id, count(*) AS n FROM documents GROUP BY 1)
SELECT s_suppkey AS source_id, 'P' || (s_suppkey % 3) AS priority, coalesce(n, 0)::BIGINT AS documents FROM supplier LEFT JOIN n ON source_id = s_suppkey""")
def _(t):
    return reports.sources_with_counts(sources(t), documents(t)).select("source_id", "priority", "documents")


@query("source_coverage", """
WITH few AS (SELECT * FROM supplier ORDER BY s_suppkey DESC LIMIT 40)
SELECT s_suppkey AS source_id, count(l_orderkey)::BIGINT AS documents FROM few LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 10""")
def _(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("source_id"))
    return reports.source_coverage(sources(t), rows).select("source_id", "documents")


@query("feedback_list", "SELECT doc_id AS feedback_id, quality = 1 AS useful FROM labels ORDER BY doc_id % 100 DESC, doc_id DESC LIMIT 50")
def _(t):
    rows = t("labels").select(
        F.col("doc_id").alias("feedback_id"), (F.col("quality") == 1).alias("useful"), (F.col("doc_id") % 100).alias("created_at")
    )
    return reports.feedback_list(rows).select("feedback_id", "useful")


@query("latency_summary", """
SELECT event_type, count(*) FILTER (WHERE event_type <> 'error' OR event_id % 3 = 0)::BIGINT AS completed, count(*) FILTER (WHERE NOT (event_type <> 'error' OR event_id % 3 = 0))::BIGINT AS failed,
 round_even(median(value) FILTER (WHERE event_type <> 'error' OR event_id % 3 = 0), 0) AS median, max(value) FILTER (WHERE event_type <> 'error' OR event_id % 3 = 0) AS max,
 quantile_disc(value, 0.95) FILTER (WHERE event_type <> 'error' OR event_id % 3 = 0) AS p95 FROM events GROUP BY event_type""")
def _(t):
    ran = (F.col("event_type") != "error") | (F.col("event_id") % 3 == 0)
    return reports.latency_summary(t("events").withColumn("wall_ms", F.when(ran, F.col("value"))), ("event_type",))


@query("latency_summary_sketch")
def _(t):
    return reports.latency_summary(t("events").withColumn("wall_ms", F.col("value")), ("event_type",), exact=False)


@query("quality_flags", """
SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 4 = 0 THEN 'empty_answer' END, CASE WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN 'claim_without_source' END,
 CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'invented_topic_not_marked_missing' END], lambda x: x IS NOT NULL), '|') AS flags FROM events""")
def _(t):
    i = F.col("event_id")
    answer = F.when(i % 4 == 0, "  ").otherwise("da")
    status = F.when(i % 3 == 0, "missing").when(i % 3 == 1, "supported").otherwise("conflict")
    return t("events").select("event_id", joined(reports.quality_flags(answer, status, i % 5, F.col("event_type") == "error")).alias("flags"))


@query("corpus_progress", """
SELECT count(*)::BIGINT AS documents, 5000::BIGINT AS target, least(100.0, round_even(100.0 * count(*) / 5000, 1))::DOUBLE AS progress_pct, count(*) >= 100 AS ready FROM documents""")
def _(t):
    return reports.progress(t("documents")).select("documents", F.col("target").cast("long"), F.col("progress_pct").cast("double"), "ready")


# --- costs -------------------------------------------------------------------------------

MODELS = "models(provider, label, per_in, per_out) AS (VALUES " + ", ".join(
    f"('{m[0]}', '{sql_text(m[1])}', {m[3]}::DOUBLE, {m[4]}::DOUBLE)" for m in prices.LANGUAGE_MODELS
) + ")"
USAGE_SQL = f"""{MODELS}, usage AS (SELECT event_type, count(DISTINCT user_id)::BIGINT AS users, count(*)::DOUBLE / count(DISTINCT user_id) AS per_user, count(*)::BIGINT AS chunks FROM events GROUP BY event_type),
asked AS (SELECT *, round_even(users * per_user, 0)::BIGINT AS q FROM usage)"""


def usage(t):
    return t("events").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), (F.count("*") / F.count_distinct("user_id")).alias("per_user"), F.count("*").alias("chunks")
    )


def plan(**more):
    return costs.usage(active_users=F.col("users"), requests_per_user_month=F.col("per_user"), chunks_indexed=F.col("chunks"), **more)


def four(x: str) -> str:
    return f"round_even({x}, 4)"


LLM = "(q * (1400 + 1.3::DOUBLE * 400) / 1e6 * {i} + q * (420 + 1.3::DOUBLE * 120) / 1e6 * {o})"


@query("model_bill", f"""
WITH {USAGE_SQL} SELECT event_type, floor(q * (1400 + 1.3::DOUBLE * 400))::BIGINT AS input_tokens, floor(q * (420 + 1.3::DOUBLE * 120))::BIGINT AS output_tokens, {four(LLM.format(i=0.59, o=0.79))} AS total_usd FROM asked""")
def _(t):
    rows = usage(t).withColumn("questions", F.bround(F.col("users") * F.col("per_user")).cast("long"))
    return costs.model_bill(rows, plan(), "no such provider").select("event_type", "input_tokens", "output_tokens", "total_usd")


PROJECT_SQL = f"""{USAGE_SQL},
c AS (SELECT *, {four(LLM.format(i=0.15, o=0.60))} AS llm, {four(four('chunks * 400 / 1e6 * 0.02') + ' * 0.05')} AS emb, {four('q / 1000 * 2.0')} AS rr, {four('55.0 + 28 + 12 + 14 + 16 * 15')} AS fixed FROM asked),
v AS (SELECT *, {four('llm + emb + rr')} AS variable FROM c), tt AS (SELECT *, {four('variable + fixed')} AS total FROM v)"""


def projected(t, **more):
    p = plan(**more)
    return costs.project(usage(t), p, embedder="openai_embed_3_small", reranker="cohere_rerank"), p


@query("cost_projection_profit", f"""
WITH {PROJECT_SQL}, r AS (SELECT *, {four('total + 450')} AS revenue FROM tt)
SELECT event_type, q AS questions, llm AS llm_usd, emb AS embeddings_usd, variable AS variable_usd, fixed AS fixed_usd, total AS total_cost_usd, revenue AS revenue_needed_usd, {four('revenue / users')} AS price_per_user_usd,
 CASE WHEN revenue > variable THEN round_even(fixed / greatest(0.01, revenue / users - variable / users), 0)::BIGINT ELSE users END AS break_even_users FROM r""")
def _(t):
    found = projected(t)[0]
    return found.select(
        "event_type", "questions", "llm_usd", "embeddings_usd", "variable_usd", "fixed_usd", "total_cost_usd", "revenue_needed_usd",
        "price_per_user_usd", "break_even_users",
    )


@query("cost_projection_margin", f"""
WITH {PROJECT_SQL}, r AS (SELECT *, {four('total / (1 - 0.3::DOUBLE)')} AS revenue FROM tt)
SELECT event_type, revenue AS revenue_needed_usd, {four('revenue - total')} AS profit_usd, round_even(total * 17.85::DOUBLE, 0) AS total_cost_mdl, round_even(100 * {four('revenue - total')} / revenue, 1) AS margin_realized_pct FROM r""")
def _(t):
    found = projected(t, margin_pct=30.0)[0]
    return found.select("event_type", "revenue_needed_usd", "profit_usd", "total_cost_mdl", "margin_realized_pct")


SCENARIO_SQL = f"""{PROJECT_SQL}, s AS (SELECT event_type, provider, label, users, {four(LLM.format(i='per_in', o='per_out'))} AS l, emb, rr, fixed FROM tt, models WHERE provider IN ({", ".join(f"'{m}'" for m in prices.COMPARED_MODELS)})),
sc AS (SELECT *, {four('l + emb + rr + fixed')} AS stack FROM s)"""


@query("provider_scenarios", f"""
WITH {SCENARIO_SQL} SELECT event_type, provider, stack AS stack_total_usd, round_even(stack * 17.85::DOUBLE, 0) AS stack_total_mdl, {four('(stack + 450) / users')} AS price_per_user_usd FROM sc""")
def _(t):
    found, p = projected(t)
    return costs.scenarios(found, p, ("event_type",)).select("event_type", "provider", "stack_total_usd", "stack_total_mdl", "price_per_user_usd")


@query("sensitivity_grid", f"""
WITH {PROJECT_SQL}, g AS (SELECT DISTINCT event_type, u, r, round_even(u * r, 0)::BIGINT AS q, emb, rr, fixed FROM tt, unnest([greatest(1, users // 2), users, users * 2, users * 5]) AS a(u), unnest([greatest(1.0, per_user / 2), per_user, per_user * 2]) AS b(r))
SELECT event_type, u::BIGINT AS users, round(r, 6) AS req_per_user, q AS questions, {four(four(LLM.format(i=0.15, o=0.60)) + ' + emb + rr + fixed')} AS total_cost_usd FROM g""")
def _(t):
    found, p = projected(t)
    grid = costs.sensitivity(found, p, ("event_type",))
    return grid.select("event_type", "users", F.round("req_per_user", 6).alias("req_per_user"), "questions", "total_cost_usd")


@query("cheapest_provider", f"""
WITH {SCENARIO_SQL}, b AS (SELECT event_type, arg_min(provider, (stack, provider)) AS cheapest, min(stack) AS low, max(stack) FILTER (WHERE provider = 'groq_gpt_oss_120b') AS cur FROM sc GROUP BY event_type)
SELECT event_type, cheapest, CASE WHEN cheapest <> 'groq_gpt_oss_120b' THEN {four('cur - low')} ELSE 0.0 END AS saving_usd FROM b""")
def _(t):
    found, p = projected(t)
    return costs.recommend(costs.scenarios(found, p, ("event_type",)), ("event_type",)).select("event_type", "cheapest", "saving_usd")


@query("cheapest_provider_advice")
def _(t):
    found, p = projected(t)
    return costs.recommend(costs.scenarios(found, p, ("event_type",)), ("event_type",)).select("event_type", "advice")
