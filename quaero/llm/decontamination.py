"""Benchmark decontamination with a positional inverted index of the training texts.

The index holds, for each document, the positions of the test terms that some window needs: its ``rare`` rarest words by
their count in the whole corpus. Lists are intersected at their offsets from the rarest term on; what agrees in all of them
is compared word for word with the words kept beside the rarest term's posting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaero.llm.common import ascii_words, numbered, small, stored


@dataclass
class Matches:
    """``lengths``: row_id, doc_id, n_words of every document; ``places``: row_id, window_id, start, len, exact;
    ``windows``: window_id, item_id."""

    lengths: DataFrame
    places: DataFrame
    windows: DataFrame


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """window_id, item_id, gram: every ``window`` consecutive words of an item; a shorter item is one, an empty one none."""
    words = items.select("item_id", ascii_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))).alias("first")
    grams = words.select("item_id", "words", first).select(
        "item_id", F.slice("words", F.col("first"), F.lit(window)).alias("gram")
    )
    return grams.select(F.xxhash64(F.array_join("gram", " ")).alias("window_id"), "item_id", "gram").distinct()


def tokens(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, words, n_words of each document."""
    return numbered(docs.select("doc_id", "text")).select(
        "row_id", "doc_id", ascii_words(F.col("text")).alias("words")
    ).withColumn("n_words", F.size("words"))


def rare_terms(docs: DataFrame, grams: DataFrame, rare: int) -> DataFrame:
    """window_id, off, len, rank, term, gram: the ``rare`` words of each window that the corpus has least often.

    A window with a word that the corpus lacks occurs nowhere and is left out.
    """
    places = grams.select("window_id", "gram", F.posexplode("gram").alias("off", "term"))
    vocabulary = stored(places.select("term").distinct(), "terms")
    counts = (
        tokens(docs)
        .select(F.explode_outer("words").alias("term"))
        .join(small(vocabulary), "term")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = W.partitionBy("window_id").orderBy("n", "off")
    whole = W.partitionBy("window_id")
    return (
        places.join(counts, "term", "left")
        .withColumn("rank", F.row_number().over(order))
        .withColumn("missing", F.max(F.col("n").isNull()).over(whole))
        .filter(~F.col("missing") & (F.col("rank") <= rare))
        .select("window_id", "off", F.size("gram").alias("len"), "rank", "term", "gram")
    )


def positional_index(docs: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """row_id, doc_id, n_words, pos, term, near, near_from, last: the postings of ``terms`` (term, leading) in all documents.

    ``near`` holds the words around a leading term. The last word of a document is always there, as the record of its length;
    an empty document has one row without position.
    """
    here = F.col("pos")
    start = F.greatest(here - (window - 1), F.lit(0))
    placed = tokens(docs).select("row_id", "doc_id", "words", "n_words", F.posexplode_outer("words").alias("pos", "term"))
    last = here.isNull() | (here == F.col("n_words") - 1)
    return (
        placed.join(small(terms), "term", "left")
        .filter(F.col("leading").isNotNull() | last)
        .select(
            "row_id", "doc_id", "n_words", "pos", F.when(F.col("leading").isNotNull(), F.col("term")).alias("term"),
            F.when(F.col("leading"), F.slice("words", start + 1, here - start + window)).alias("near"),
            F.when(F.col("leading"), start).alias("near_from"), last.alias("last"),
        )
    )


def find_phrases(docs: DataFrame, items: DataFrame, window: int = 10, rare: int = 3, slop: int = 5) -> Matches:
    """Places of the items' windows in the documents.

    docs: doc_id, text; items: item_id, text; other columns are not read. A place is exact if all words of the window stand
    there in a row; otherwise it is a proximity match: each rare term of the window within ``slop`` words of where the rarest
    one puts it. Null and empty texts have no words and no places; repeated rows are matched each for itself; a document
    without a number keeps its row. No items or no documents: no places.
    """
    grams = stored(item_windows(items, window), "windows")
    distinct = grams.select("window_id", "gram").distinct()
    rare_words = stored(rare_terms(docs, distinct, rare), "rare")
    terms = rare_words.groupBy("term").agg(F.max(F.col("rank") == 1).alias("leading"))
    index = stored(positional_index(docs, terms, window), "postings")
    ranks = rare_words.groupBy("window_id").agg(F.max("rank").alias("ranks"))
    lead = rare_words.filter("rank = 1").join(ranks, "window_id").select("window_id", "off", "len", "term", "gram", "ranks")
    start = F.col("pos") - F.col("off")
    found = (
        index.filter("near is not null")
        .join(small(lead), "term")
        .select(
            "row_id", "window_id", start.alias("start"), "len", "ranks",
            ((start >= 0) & (F.slice("near", F.greatest(start - F.col("near_from"), F.lit(0)) + 1, F.col("len")) == F.col("gram"))).alias("same"),
        )
    )
    others = rare_words.filter("rank > 1").select("window_id", "rank", "term", F.col("off").alias("other_off"))
    # Postings are met by cells of positions, so that a word that fills a document does not meet all its own places.
    cell = lambda position: F.floor(position / (2 * slop + 1))
    lists = index.filter("term is not null").select("row_id", "term", cell(F.col("pos")).alias("cell"), F.col("pos").alias("other_pos"))
    place = F.col("start") + F.col("other_off")
    shift = F.col("other_pos") - place
    cells = F.explode(F.array_distinct(F.array(cell(place - slop), cell(place + slop)))).alias("cell")
    wanted = found.join(small(others), "window_id").select("*", cells)
    agreeing = (
        wanted.join(lists, ["row_id", "term", "cell"])
        .filter(F.abs(shift) <= slop)
        .groupBy("row_id", "window_id", "start", "len", "ranks", "same", "rank")
        .agg(F.max(shift == 0).alias("in_place"))
        .groupBy("row_id", "window_id", "start", "len", "ranks", "same")
        .agg(F.count(F.lit(1)).alias("near"), F.sum(F.col("in_place").cast("int")).alias("exact"))
        .filter("near = ranks - 1")
        .select("row_id", "window_id", "start", "len", (F.col("same") & (F.col("exact") == F.col("ranks") - 1)).alias("exact"))
    )
    alone = found.filter("ranks = 1").select("row_id", "window_id", "start", "len", F.col("same").alias("exact"))
    lengths = index.filter("last").select("row_id", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    return Matches(lengths, agreeing.unionByName(alone), grams.select("window_id", "item_id"))


def _covered(places: DataFrame) -> DataFrame:
    """row_id, n_hit: words inside any of a document's places."""
    spans = places.groupBy("row_id", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = F.max("end").over(W.partitionBy("row_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    return spans.withColumn("new", new).groupBy("row_id").agg(F.sum("new").alias("n_hit"))


def _items(matches: Matches, places: DataFrame) -> DataFrame:
    pairs = places.select("row_id", "window_id").distinct().join(small(matches.windows), "window_id")
    return pairs.select("row_id", F.col("item_id").cast("string").alias("item")).filter("item is not null").distinct()


def sha256_of(ids: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(ids), ",").cast("binary"), 256)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, rare: int = 3, slop: int = 5) -> DataFrame:
    """One row per document: how many of its words lie in benchmark windows and which items they come from.

    ``n_near`` counts the items with a proximity or exact match. Items without a number hit words but are not listed.
    """
    matches = find_phrases(docs, items, window, rare, slop)
    places = stored(matches.places, "places")
    exact = places.filter("exact")
    found = _items(matches, exact).groupBy("row_id").agg(F.collect_list("item").alias("items"))
    near = _items(matches, places).groupBy("row_id").agg(F.count(F.lit(1)).alias("n_near"))
    per_row = _covered(exact).join(found, "row_id", "full").join(near, "row_id", "full")
    none = F.array().cast("array<string>")
    return matches.lengths.join(per_row, "row_id", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        sha256_of(F.coalesce("items", none)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
