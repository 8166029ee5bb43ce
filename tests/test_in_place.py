"""The word index is laid out by cell, and its blocks are read for the words that are asked for."""

import pyarrow as pa

from quaero.operators import lexical, postings_index
from quaero.operators.postings_index import PostingsIndex


def plan_of(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan =="):]


def test_a_cell_is_laid_out_from_the_texts_of_its_chunks():
    rows = {"cell": [3] * 4, "chunk_id": [9, 5, 7, 5], "_n": [1, 0, None, 0], "len": [2, 1, None, 1], "_words": [["b", "a", "b"], ["b"], None, ["b"]]}
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
    told = postings_index._cell_blocks(pa.table({c: pa.array(v, t) for (c, v), t in zip(rows.items(), types)})).to_pylist()
    assert {b.pop("term"): list(b.values()) for b in told} == {
        "a": [3, 1, 1, 2.0, [9], [1], [2], [[2]]], "b": [3, 2, 2, 0.5, [5, 9], [2, 1], [1, 2], [[1, 1], [-1, 3]]],
    }


def test_blocks_leave_the_scan_for_words_that_are_asked_for_only(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"w{i % 9} w{i % 4} of", f"part{i % 3}") for i in range(600)], "chunk_id long, content string, section string")
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "part2 w3 of"), (3, '"w3 of" -w5')], "query_id long, question string")
    index = PostingsIndex(spark, str(tmp_path))
    index.add(chunks)
    ranked = index.bm25_topk(queries)
    plan = plan_of(ranked)
    assert "BroadcastHashJoin [term" in plan and "SortMergeJoin [segment" not in plan.split("_open")[0]
    show = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in df.collect())
    assert show(ranked) == show(lexical.bm25_topk(chunks, queries))
    assert show(index.lexical_topk(queries)) == show(lexical.lexical_topk(chunks, queries))
