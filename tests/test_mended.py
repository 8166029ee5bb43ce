"""Cases in which a row used to be lost or mistaken."""

from pyspark.sql import functions as F

from checks.evidence import asks
from quaero.operators import dense, evidence, frontier, html, keyed, lexical, lookup


def test_an_address_is_found_by_its_end_only(spark):
    docs = spark.createDataFrame(
        [(1, "a", "https://x.org/doc/120", "h", "one"), (2, "b", "https://x.org/doc/12", "h", "two"), (3, "c", "https://y.org/12", "h", "three")],
        "document_id long, title string, url string, mime_type string, content string",
    )
    wanted = spark.createDataFrame(
        [(1, None, "x.org/doc/12"), (2, None, "X.ORG/doc/120"), (3, None, "/12"), (4, None, "doc/1"), (5, 3, None), (6, None, "")],
        "request_id long, document_id long, url string",
    )
    found = {r.request_id: r.document_id for r in lookup.read_documents(wanted, docs).collect()}
    assert found == {1: 2, 2: 1, 3: 2, 5: 3}


def test_short_needles_are_found(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, "xbcx"), (3, ""), (4, None)], "id long, body string")
    needles = spark.createDataFrame([("b",), ("bc",), ("abcde",), ("zz",), ("",)], "needle string")
    found = {(r.id, r.needle) for r in keyed.contains_join(texts, "body", needles, "needle").collect()}
    assert found == {(1, "b"), (1, "bc"), (1, "abcde"), (2, "b"), (2, "bc")}


def test_queries_of_all_widths_are_answered_alike(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None)], "query_id long, embedding array<double>")
    chunks = spark.createDataFrame(
        [(1, [1.0, 1.0]), (2, [0.0, 2.0, 0.0]), (3, [1.0, 1.0, 1.0]), (4, [1.0])], "chunk_id long, embedding array<double>"
    )
    wanted = {(1, 1, 1), (2, 2, 1), (2, 3, 2)}
    for values in (None, 2):
        found = dense.dense_topk(queries, chunks, broadcast_values=values)
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in found.collect()} == wanted


def test_a_deep_tree_of_sitemaps_is_read_to_its_end(spark):
    page = lambda u: f"<urlset><url><loc>{u}</loc></url></urlset>"
    rows = [(f"https://h.org/sitemap{i}.xml", 200, page(f"https://h.org/sitemap{i + 1}.xml")) for i in range(24)]
    rows.append(("https://h.org/sitemap24.xml", 200, page("https://h.org/leaf")))
    stored = spark.createDataFrame(rows, "url string, status int, content string")
    roots = spark.createDataFrame([("h.org", "https://h.org/sitemap0.xml")], "host string, url string")
    found = frontier.harvest_sitemaps(roots, stored).select(F.col("url"))
    assert [r.url for r in found.collect()] == ["https://h.org/leaf"]


def test_contacts_are_looked_up_once_for_equal_questions_and_topics(spark, monkeypatch):
    seen = []
    first_rows = evidence.first_rows
    monkeypatch.setattr(evidence, "first_rows", lambda df, *rest: (seen.append(df.count()), first_rows(df, *rest))[1])
    asked = spark.range(300).select(
        F.col("id").alias("query_id"), F.when(F.col("id") % 3 < 2, "Caut parcare rezidențială").otherwise("zzz").alias("question"),
        F.lit(None).cast("string").alias("institution"),
    )
    links = spark.range(1, 201).select(
        F.col("id").alias("link_id"), F.lit("parcare rezidențială").alias("topic_ro"), F.lit(None).cast("string").alias("topic_ru"),
        F.col("id").cast("string").alias("url"), F.concat(F.lit("Ghișeu "), F.col("id").cast("string")).alias("contact_label"),
        F.lit("tel").alias("contact_value"),
    )
    found = {r.query_id: r.label for r in evidence.contact_for(asked, links).collect()}
    assert len(found) == 300 and {found[i] for i in found if i % 3 < 2} == {"Ghișeu 1"} and "Ghișeu 1" not in {found[i] for i in range(2, 300, 3)}
    assert seen == [1]  # one question meets one topic, not 200 questions 200 topics


def test_of_texts_alike_in_length_the_first_is_the_question(spark):
    for order in ("doc_id", "-doc_id"):
        docs = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(8)], "doc_id long, text string").orderBy(F.expr(order)).coalesce(1)
        assert [r.question for r in asks(lambda _: docs).collect()] == ["text 1"]


def test_tasks_of_the_word_search_grow_with_chunks_and_queries(spark, monkeypatch):
    assert lexical.tasks_for(3_000_000, 200, 8) == 600 and lexical.tasks_for(10, 10, 8) == 8
    chunks = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(1, 9))) for i in range(60)] + [(90, None), (91, "")], "chunk_id long, content string")
    queries = spark.createDataFrame([(0, "w1 w5"), (1, "w7 w7 none"), (2, None)], "query_id long, question string")
    shown = lambda: sorted((r.query_id, r.chunk_id, r["rank"], round(r.score, 9)) for r in lexical.bm25_topk(chunks, queries, 5).collect())
    whole = shown()
    assert len(whole) == 10
    monkeypatch.setattr(lexical, "PAIRS", 10)
    monkeypatch.setattr(lexical, "SENT", 0)
    assert shown() == whole


def test_pages_are_read_a_few_at_a_time():
    rows = [{"page_id": i, "url": "https://x.org/a", "html": f"<p>t{i}<a href='/b'>c</a>" if i else None} for i in range(250)]
    out = list(html.read_pages(iter([html.pa.RecordBatch.from_pylist(rows)])))
    assert [b.num_rows for b in out] == [100, 100, 50]
    assert [r["page_id"] for b in out for r in b.to_pylist()] == list(range(250))
    assert out[0].to_pylist()[1]["pieces"][0]["t"] == "t1" and out[0].to_pylist()[0]["pieces"] == []
