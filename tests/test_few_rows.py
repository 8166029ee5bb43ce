"""Large tables that few rows pick from."""

from pyspark.sql import functions as F

from quaero.operators import facts, lookup
from quaero.plans import crawl


def plan_of(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan =="):]


def test_texts_are_not_shuffled_for_the_few_that_are_shown(spark):
    docs = spark.range(500).select(F.col("id").alias("document_id"), F.lit("t").alias("title"), F.lit("u").alias("url"))
    chunks = spark.range(500).select(
        F.col("id").alias("document_id"), (F.col("id") * 10).alias("chunk_id"), F.lit("text").alias("content"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"),
    )
    hits = spark.createDataFrame([(1, 7, 9999, 1), (1, 8, 80, 2)], "query_id long, document_id long, chunk_id long, pos int")
    more = lookup.related_chunks(hits, chunks, docs)
    assert [(r.pos, r.chunk_id) for r in more.collect()] == [(1, 70)]
    plan = plan_of(more)
    assert plan.count("BroadcastHashJoin [document_id") >= 2 and "LeftSemi" in plan


def test_a_crawl_does_not_sort_out_all_links_in_every_round(spark, monkeypatch):
    plans, cut = [], crawl.cut_lineage
    monkeypatch.setattr(crawl, "cut_lineage", lambda df: (plans.append(plan_of(df)), cut(df))[1])
    page = lambda c: F.concat(F.lit("https://x.org/p"), c.cast("string"))
    links = spark.range(3000).select(page(F.col("id")).alias("page_url"), page(F.col("id") + 1).alias("url")).distinct()
    pages = spark.range(3000).select(page(F.col("id")).alias("url"), F.lit(200).alias("status")).distinct()
    one = lambda value, name: spark.createDataFrame([(value,)], f"{name} string")
    found = crawl.crawl_job(pages, links, one("https://x.org/p0", "url"), one("x.org", "host"), max_depth=2)
    assert [r.url for r in found.orderBy("depth").collect()] == [f"https://x.org/p{i}" for i in range(3)]
    read = [p for p in plans if "Range" in p]
    # What is not asked for goes before the rest is made distinct.
    assert len(read) == 6 and all("LeftSemi" in p and p.rindex("LeftSemi") > p.rindex("HashAggregate") for p in read)


def test_claims_are_read_once_for_each_side_and_questions_once_in_all(spark):
    hits = spark.range(2000).select(
        (F.col("id") % 3).alias("query_id"), F.lit("Ce termen are autorizația de demolare?").alias("question"), F.lit(1).alias("pos"),
        F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.lit("Autorizația de demolare").alias("document_title"),
        F.when(F.col("id") % 5 > 1, F.concat(F.lit("u"), F.col("id").cast("string"))).when(F.col("id") % 5 == 1, "").alias("document_url"),
        F.concat(F.lit("Se emite autorizația de demolare în termen de "), (F.col("id") % 7 + 2).cast("string"), F.lit(" zile.")).alias("content"),
        F.lit(1).alias("page"),
    )
    found = facts.conflicts(hits)
    assert sorted((r.query_id, r.pair, r.left.document_id, r.right.document_id) for r in found.collect()) == [
        (q, k, q, q + 3 * k) for q in range(3) for k in (1, 2, 3)
    ]
    plan = plan_of(found)
    plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert plan.count("Generate posexplode") <= 2 and "Union" not in plan and "concurs" not in plan


def test_hits_are_laid_out_once_and_without_texts_that_nobody_asks_for(spark):
    hits = spark.range(400).select(
        (F.col("id") % 40).alias("query_id"), F.lit("Ce termen are autorizația de demolare?").alias("question"), F.lit(1).alias("pos"),
        F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.lit("Autorizația de demolare").alias("document_title"),
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("document_url"),
        F.concat(F.lit("Se emite autorizația de demolare în termen de "), (F.col("id") % 7 + 2).cast("string"), F.lit(" zile.")).alias("content"),
        F.col("id").cast("int").alias("page"),
    )
    found = facts.conflicts(hits)
    assert plan_of(found).count("Exchange hashpartitioning") == 1
    values = plan_of(found.select("query_id", "left.value"))
    sent = [line for line in values[values.index("Exchange hashpartitioning"):].split("\n") if "Project [" in line][0]
    assert values.count("Exchange hashpartitioning") == 1 and "document_url#" in sent
    assert not any(f"AS {c}#" in sent for c in ("quote", "document_title", "page"))
    first = found.filter("query_id = 3 and pair = 1").first()
    assert (first.left.document, first.left.page, first.left.quote[:8], first.right.page) == ("Autorizația de demolare", "3", "Se emite", "43")
