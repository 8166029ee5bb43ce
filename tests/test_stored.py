"""Tables that are merged when read, stored word and vector indexes, line diffs: against the direct forms."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from quaero.operators import dense, lexical, lookup, versioning
from quaero.operators.gram_index import GramIndex
from quaero.operators.postings_index import PostingsIndex
from quaero.operators.quantized import QuantizedIndex
from quaero.plans.store import CorpusStore, SearchIndex
from quaero.sources.merge_table import STEP, MergeTable

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed=1, common=6):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS if rng.random() < 0.6 else WORDS[:common]) for _ in range(rng.randrange(1, 60))) + f" only{i}") for i in range(n)]


def chunk_rows(spark, rows):
    return spark.createDataFrame([(i, c, f"part w{i % 7}" if i % 5 == 0 else None) for i, c in rows], "chunk_id long, content string, section string")


def asked(spark, questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")


def shown(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in df.collect())


QUESTIONS = ["w1 w2 w50", "only17 w3", "w0 w0", "nothing known", "", "w59 only200 only3 only9999", '"w1 w2" -w3 or w40 w41', "w5 -w6"]


def test_stored_words_find_what_the_direct_search_finds(spark, tmp_path):
    chunks, queries = chunk_rows(spark, texts(1200)), asked(spark, QUESTIONS)
    index = PostingsIndex(spark, str(tmp_path))
    index.add(chunks, cluster=F.col("chunk_id") % 3)
    for k in (1, 18):
        assert shown(index.bm25_topk(queries, k)) == shown(lexical.bm25_topk(chunks, queries, k))
        assert shown(index.lexical_topk(queries, k)) == shown(lexical.lexical_topk(chunks, queries, k))
        assert shown(index.lexical_topk(queries, k, plain=True)) == shown(lexical.lexical_topk(chunks, queries, k, plain=True))
    assert shown(index.bm25_topk(queries, 9, k1=0.4, b=0.1)) == shown(lexical.bm25_topk(chunks, queries, 9, k1=0.4, b=0.1))


def test_removed_and_added_chunks_count_as_if_indexed_at_once(spark, tmp_path):
    rows = texts(700)
    index = PostingsIndex(spark, str(tmp_path))
    index.add(chunk_rows(spark, rows[:500]))
    index.remove(chunk_rows(spark, rows[100:250]))
    # A number may come back with another text.
    again = [(i, c + " w1 w1 changed") for i, c in rows[100:150]]
    segment = index.add(chunk_rows(spark, rows[500:] + again))
    now = chunk_rows(spark, rows[:100] + rows[250:] + again)
    queries = asked(spark, [*QUESTIONS, "changed w1", "only120", "only60 only620"])
    assert shown(index.bm25_topk(queries)) == shown(lexical.bm25_topk(now, queries))
    assert shown(index.lexical_topk(queries)) == shown(lexical.lexical_topk(now, queries))
    index.add(chunk_rows(spark, rows[500:] + again), segment)
    assert shown(index.bm25_topk(queries)) == shown(lexical.bm25_topk(now, queries))


def test_cells_that_cannot_hold_a_best_chunk_stay_closed(spark, tmp_path):
    """Three languages, of which a question has words of one; and chunks in which its rare words stand together."""
    rows = [(i, " ".join(f"{'abc'[i % 3]}{(i * j) % 97}" for j in range(1, 40))) for i in range(1500)]
    rows += [(2000 + i, "rare words a7 stand here together " * 3) for i in range(40)]
    index = PostingsIndex(spark, str(tmp_path))
    index.add(chunk_rows(spark, [(i, c) for i, c in rows]), cluster=F.substring("content", 1, 1))
    queries = asked(spark, ["rare words a7", "b5 b6"])
    segments, n, words = index._manifest()
    cells = index.open_cells(index.weights(queries, segments, n), segments, words / n, 5, 1.2, 0.75)
    seen = {(r.query_id, r.open): r["count"] for r in cells.groupBy("query_id", "open").count().collect()}
    all_cells = index._of("blocks", segments).select("cell").distinct().count()
    assert seen[0, True] < seen[0, False] + seen[0, True] <= all_cells and seen[0, True] <= 4
    plan = index.bm25_topk(queries, 5)._jdf.queryExecution().toString()
    assert "regexp_extract_all(content" not in plan and "regexp_extract_all" not in plan.split("== Optimized Logical Plan ==")[1]


def test_all_matches_are_returned_when_no_number_is_given(spark, tmp_path):
    rows = [(i, f"one two {'x ' * (i % 5)}three") for i in range(50)] + [(90, "one two")]
    index, queries = PostingsIndex(spark, str(tmp_path)), asked(spark, ["three one", "three or two"])
    index.add(chunk_rows(spark, rows))
    found = {(r.query_id, r.chunk_id, r["rank"]) for r in index.lexical_topk(queries, k=None).collect()}
    assert len(found) == 101 and found == {
        (r.query_id, r.chunk_id, r["rank"]) for r in lexical.lexical_topk(chunk_rows(spark, rows), queries, k=None).collect()
    }
    assert {r for q, _, r in found if q == 0} == set(range(1, 51))


def test_an_empty_index_finds_nothing(spark, tmp_path):
    index, queries = PostingsIndex(spark, str(tmp_path)), asked(spark, QUESTIONS)
    assert index.bm25_topk(queries).collect() == [] and index.lexical_topk(queries).collect() == []
    index.add(chunk_rows(spark, []))
    assert index.bm25_topk(queries).collect() == []


def clustered(spark, n, seed, name, width=24):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(5).normal(size=(20, width))
    rows = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, width)) * 0.6
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{name} long, embedding array<float>")


def test_quantized_search_finds_nine_of_ten_and_is_loaded_again(spark, tmp_path):
    chunks = clustered(spark, 3000, 1, "chunk_id").unionByName(
        spark.createDataFrame([(9000, None), (9001, [0.0] * 24), (9002, [1.0])], "chunk_id long, embedding array<float>")
    ).cache()
    queries = clustered(spark, 40, 2, "query_id").unionByName(spark.createDataFrame([(90, [1.0, 2.0]), (91, None)], "query_id long, embedding array<float>"))
    index = QuantizedIndex.build(chunks, str(tmp_path), cells=40)
    exact = dense.dense_topk(queries.filter("query_id < 90"), chunks.filter("chunk_id < 9000"))
    for found in (index.topk(queries), QuantizedIndex.load(spark, str(tmp_path)).topk(queries)):
        assert dense.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
        true = {(r.query_id, r.chunk_id): round(r.score, 9) for r in exact.collect()}
        assert all(true.get((r.query_id, r.chunk_id), round(r.score, 9)) == round(r.score, 9) for r in found.collect())
    assert index.probes < 40
    assert shown(index.topk(queries, probes=40, reranked=400)) == shown(exact)
    # A removed chunk is found no more, one that is added is.
    first = exact.filter("query_id = 0 and rank = 1").first()["chunk_id"]
    index.remove(spark.createDataFrame([(first,)], "chunk_id long"), 2)
    index.add(spark.createDataFrame([(9500, queries.filter("query_id = 0").first()["embedding"])], "chunk_id long, embedding array<float>"), 3)
    got = {r["rank"]: r.chunk_id for r in index.topk(queries).filter("query_id = 0").collect()}
    assert got[1] == 9500 and first not in got.values()


def test_vectors_that_lie_close_together_are_cut_into_more_parts(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = lambda n, name: spark.createDataFrame(
        [(i, [float(x) for x in r]) for i, r in enumerate(1 + rng.normal(size=(n, 64)) * 0.1)], f"{name} long, embedding array<float>"
    )
    chunks, queries = made(6000, "chunk_id").cache(), made(20, "query_id")
    index = QuantizedIndex.build(chunks, str(tmp_path), cells=20)
    assert len(index.quantizer.words) > 8
    found = dense.recall(index.topk(queries), dense.dense_topk(queries, chunks)).agg(F.avg("recall")).first()[0]
    assert found >= 0.9


def table_rows(spark, rows):
    return spark.createDataFrame(rows, "url string, document_id long, content string")


def test_merged_table_equals_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    table = MergeTable(spark, str(tmp_path), "url string, document_id long, content string", "url", ["document_id"], parts=8)
    state, written = {}, 0
    for turn in range(4):
        rows = [(f"u{rng.randrange(40)}", turn * 100 + i, f"text {turn} {i}") for i in range(12)]
        rows = list({r[0]: r for r in rows}.values())
        removed = [f"u{rng.randrange(60)}" for _ in range(5)]
        segment = table.apply(table_rows(spark, rows), spark.createDataFrame([(u,) for u in removed], "url string"))
        state = {u: r for u, r in state.items() if u not in removed} | {r[0]: r for r in rows}
        written += len(rows)
        assert sorted(map(tuple, table.current().collect())) == sorted(state.values())
        assert sorted((r.url, r.document_id) for r in table.keys().collect()) == sorted(r[:2] for r in state.values())
        # Only what changed is written, and a repeated run replaces itself.
        assert table._read("rows").count() == written
        table.apply(table_rows(spark, rows), spark.createDataFrame([(u,) for u in removed], "url string"), segment)
        assert sorted(map(tuple, table.current().collect())) == sorted(state.values()) and table._read("rows").count() == written
    before = sorted(map(tuple, table.current().collect()))
    rewritten = table.compact()
    assert rewritten and sorted(map(tuple, table.current().collect())) == before
    assert all(share < 0.25 for share in table.gone_shares().values())
    assert sorted((r.url, r.document_id) for r in table.keys().collect()) == sorted(r[:2] for r in state.values())
    table.apply(table_rows(spark, [("u1", 9, "after"), ("new", 10, "after")]))
    state |= {"u1": ("u1", 9, "after"), "new": ("new", 10, "after")}
    assert sorted(map(tuple, table.current().collect())) == sorted(state.values())


def test_hunks_turn_the_old_text_into_the_new(spark):
    rng, rows = random.Random(4), []
    for i in range(300):
        lines = [str(rng.randrange(rng.choice([2, 6, 50]))) for _ in range(rng.randrange(14))]
        other = [x for x in lines if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            other.insert(rng.randrange(len(other) + 1), str(rng.randrange(50)))
        rows.append((i, "\n".join(lines), "\n".join(other)))
    rows += [(900, None, "a\nb"), (901, "a", None), (902, "same", "same"), (903, "x\n" * 3000, "y\n" + "x\n" * 2999)]
    df = spark.createDataFrame(rows, "id long, old string, new string").withColumn("hunks", versioning.line_hunks(F.col("old"), F.col("new")))
    for r in df.withColumn("made", versioning.apply_hunks(F.col("old"), F.col("hunks"))).collect():
        assert r.made == (r.new or ""), r
        assert all(h.removed or h.added for h in r.hunks) and (r.old != r.new or not r.hunks)
    long = versioning.hunks_of("\n".join(map(str, range(100_000))), "\n".join(map(str, range(1, 100_001))))
    assert long == [(1, ["0"], 1, []), (100_001, [], 100_000, ["100000"])]


def pages(spark, rows):
    page = "<html><head><title>{0}</title></head><body><main><p>{1}</p></main></body></html>"
    return spark.createDataFrame(
        [(i, u, u, s, "text/html", page.format(f"Page {i}", c)) for i, u, s, c in rows],
        "page_id long, url string, final_url string, status int, content_type string, html string",
    )


def test_store_follows_its_pages(spark, tmp_path):
    """Two runs, the second run twice: documents, chunks, changes and both searches are those of the pages as they stand."""
    store = CorpusStore(spark, str(tmp_path / "corpus"), SearchIndex(spark, str(tmp_path / "index")))
    long = "plain sentence about harbour number {} and its boats, long enough to be kept as a document of its own."
    url = "https://example.org/{}".format
    at = datetime.datetime(2026, 1, 1)
    first = pages(spark, [(i, url(i), 200, long.format(i)) for i in range(8)])
    assert {r.status for r in store.ingest(first, at, STEP).collect()} == {"new"}
    ids = {r.url: r.document_id for r in store.documents.current().collect()}
    assert sorted(ids.values()) == list(range(1, 9))
    second = pages(spark, [(0, url(0), 200, long.format(0)), (1, url(1), 200, long.format("one hundred")), (2, url(2), 404, "gone"), (9, url(9), 200, long.format(9))])
    for _ in range(2):
        status = {r.url: (r.status, r.document_id) for r in store.ingest(second, at, 2 * STEP).collect()}
    assert status == {url(0): ("unchanged", ids[url(0)]), url(1): ("updated", ids[url(1)]), url(9): ("new", 9)}
    documents = {r.url: r for r in store.documents.current().collect()}
    assert set(documents) == {url(i) for i in (0, 1, 3, 4, 5, 6, 7, 9)} and "one hundred" in documents[url(1)].content
    assert {r.url: r.document_id for r in store.documents.keys().collect()} == {u: d.document_id for u, d in documents.items()}
    chunks = store.chunks.current()
    assert sorted({r.document_id for r in chunks.collect()}) == sorted(d.document_id for d in documents.values())
    (change,) = store.change_lines().collect()
    assert change.url == url(1) and "one hundred" in change.hunks[-1].added[-1] and change.old_hash != change.new_hash
    queries = asked(spark, ["one hundred", "number 2", "harbour boats", "9"])
    assert shown(store.index.words.bm25_topk(queries)) == shown(lexical.bm25_topk(chunks, queries))
    assert {r.chunk_id for r in store.index.vectors().collect()} == {r.chunk_id for r in chunks.collect()}
    before = sorted(map(tuple, store.documents.current().collect()))
    store.compact()
    assert sorted(map(tuple, store.documents.current().collect())) == before


def test_pieces_find_what_the_texts_hold(spark, tmp_path):
    rows = [(i, c.upper() if i % 4 == 0 else c) for i, c in texts(600)] + [(900, None), (901, ""), (902, "x"), (903, "Ăș ăș țț")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    index = GramIndex(spark, str(tmp_path))
    index.add(chunks.filter("chunk_id < 300"), 1)
    index.add(chunks.filter("chunk_id >= 300"), 2)
    needles = ["w1", "w", "ăș ă", "w1 w2", "only17", "w3 only", "zz", "", "x", "w0 w1 w2 w3", "ly1", "țț", " w5 w", "w1 w1 w1", "%_"]
    found = {(r.needle, r.pos): r.chunk_id for r in index.first_holding(spark.createDataFrame([(n,) for n in needles], "needle string"), chunks, 3).collect()}
    for n in needles:
        held = [i for i, c in rows if n and n in (c or "").lower()][:3]
        assert [found[n, p] for p in range(1, 4) if (n, p) in found] == held, n
    # Only chunks with the rarest pieces of a needle are compared with it.
    few = index.candidates(spark.createDataFrame([("w3 only",), ("only17 nowhere",)], "needle string"))
    assert 0 < few.filter("needle = 'w3 only'").count() < 200 and few.filter("needle != 'w3 only'").count() == 0


def test_a_needle_that_all_questions_share_is_looked_up_once(spark, tmp_path):
    chunks = spark.createDataFrame([(i, i, c) for i, c in texts(300)], "chunk_id long, document_id long, content string")
    documents = chunks.select("document_id", F.lit("t").alias("title"), F.lit("u").alias("url"))
    phrases = spark.createDataFrame([(q, "w1 w2" if q % 2 else " W1 w2 ") for q in range(200)], "query_id long, phrase string")
    index = GramIndex(spark, str(tmp_path))
    index.add(chunks)
    direct = sorted(map(tuple, lookup.exact_phrase(phrases, chunks, documents).select("query_id", "pos", "chunk_id").collect()))
    assert direct == sorted(map(tuple, lookup.exact_phrase(phrases, chunks, documents, grams=index).select("query_id", "pos", "chunk_id").collect()))
    held = sum("w1 w2" in c for _, c in texts(300))
    assert len(direct) == 200 * min(5, held)
    assert index.candidates(phrases.select(F.lower(F.trim("phrase")).alias("needle")).distinct()).select("needle").distinct().count() == 1
