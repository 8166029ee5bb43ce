"""Registered queries against their SQL: a few by default, all with QUAERO_ALL_QUERIES=1."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare

FEW = ["hybrid_search", "lexical_topk", "chunk_packing", "upsert_documents", "page_links", "conflict_pairs", "provider_scenarios"]
NAMES = list(entry.queries()) if os.environ.get("QUAERO_ALL_QUERIES") else FEW


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, name):
    told = compare(spark, sf_dir, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert told.startswith("ROWS" if name in WITHOUT_SQL else "ok"), told


# What SQL does not tell: models, hashing embedders, parsed pages, sketches, and operators with tests of their own.
WITHOUT_SQL = {
    "chunk_pages", "document_embedding", "query_embedding", "page_main_text", "asset_references", "links_from_assets", "evidence_blocks",
    "latency_summary_sketch", "cheapest_provider_advice", "approximate_topk", "search_with_rescue", "op2_token_counts", "op4_toxicity",
    "op7_jaccard_join", "op8_packing", "op9_token_files", "op10_quality_rules", "op11_periodic_runs", "op13_simhash", "pipeline",
}


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()) - set(entry.oracle_sql()) <= WITHOUT_SQL
