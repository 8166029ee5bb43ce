"""One very long text in which what an operator looks for fills everything: time grows with its length only."""

import time

from quaero.llm import decontamination, packing, queries, toxicity
from quaero.llm.common import stored


def test_exceptions_are_swept_once():
    lexicon = toxicity.Lexicon(weights={" trash ": 1.0, " trash": 0.5}, exceptions=("trash can of",))
    matcher = toxicity.Matcher(lexicon)
    start = time.time()
    found = matcher.features(toxicity.fold("trash can of trash bin " * 40_000))
    assert time.time() - start < 10
    few = matcher.features(toxicity.fold("trash can of trash bin " * 4))
    # One of the two hits of each repetition is spared.
    assert round(found[0] * (200_000**0.5)) == 40_000 and round(few[0] * (20**0.5)) == 4


def test_a_word_that_fills_a_document_does_not_meet_all_its_places(spark):
    docs = spark.createDataFrame([(1, "same " * 30_000), (2, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "same " * 12)], "item_id long, text string")
    start = time.time()
    rows = {r.doc_id: r for r in decontamination.contamination(docs, items).collect()}
    assert time.time() - start < 30
    assert rows[1].n_hit == rows[1].n_words == 30_000 and rows[1].n_items == 1 and not rows[2].contaminated


def test_only_common_lengths_are_dealt_to_several_lots(spark):
    cut = spark.range(60_000).selectExpr("id as doc_id", "0 as piece", "if(id < 50000, 5, 6) as length", "id as ids_crc32")
    numbered = packing.numbered_within_length(stored(cut, "pieces"), {5: 50_000, 6: 10_000})
    assert numbered.select("length", "lot").distinct().count() == 4
    assert {(r.length, r.n, r.least, r.most) for r in numbered.groupBy("length").agg(
        {"k": "min", "*": "count"}).selectExpr("length", "`count(1)` as n", "`min(k)` as least", "`count(1)` - 1 as most").collect()
    } == {(5, 50_000, 0, 49_999), (6, 10_000, 0, 9_999)}
    assert numbered.select("length", "k").distinct().count() == 60_000


def test_no_session_setting_is_changed(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for query in ("op2_token_counts", "op10_quality_rules"):
        queries.QUERIES[query](spark, sf_dir).count()
    assert spark.conf.get(name) == before


def test_registered_shards_are_split(spark, sf_dir):
    assert queries.QUERIES["op5_sharding"](spark, sf_dir).agg({"depth": "max"}).first()[0] > 0
