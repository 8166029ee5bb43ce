"""Word retrieval: postings, web-style queries, cover density and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaero.functions import text as T
from quaero.functions.text import fold, string_array
from quaero.operators.keyed import first_rows, unfold
from quaero.session import cut_lineage

WORD, BETWEEN = "[\\p{L}\\p{N}]+", "[^\\p{L}\\p{N}]+"
# Weights of the section and of the content.
WEIGHTS = {"A": 1.0, "B": 0.4}
# Pairs of a query and a chunk that a task adds up and orders at the most, as long as the tasks are not too many.
PAIRS, MOST_TASKS = 1_000_000, 20_000
# Words of queries that are sent to every task: counted before.
SENT = 200_000


def words_of(c: Column | str) -> Column:
    """Folded words of a text in order, cut at what lies between them: matching makes an object for each word."""
    return F.array_remove(F.split(fold(c), BETWEEN), "")


def word_positions(chunks: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """``(chunk_id, term, pos, weight)``: section words first with weight A, then content."""
    section = words_of("section") if "section" in chunks.columns else string_array([])
    split = chunks.select(
        F.col(id_column).alias("chunk_id"), section.alias("_section"), words_of("content").alias("_content")
    ).select("chunk_id", F.size("_section").alias("_n"), F.concat("_section", "_content").alias("_words"))
    return unfold(split, ["chunk_id", "_n"], "_words", "_at", "term").select(
        "chunk_id", "term", (F.col("_at") + 1).alias("pos"),
        F.when(F.col("_at") < F.col("_n"), "A").otherwise("B").alias("weight"),
    )


def postings(chunks: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(term, chunk_id, tf, positions)``; only the vocabulary's terms when one is given.

    Words are laid out by chunk before they are counted, so that later grouping
    by (query, chunk) needs no further shuffle.
    """
    words = word_positions(chunks)
    if vocabulary is not None:
        words = words.join(vocabulary.select("term").distinct(), "term", "left_semi")
    placed = words.repartition("chunk_id")
    return placed.groupBy("chunk_id", "term").agg(
        F.count("*").alias("tf"),
        F.array_sort(F.collect_list(F.struct("pos", "weight"))).alias("positions"),
    )


def query_terms(queries: DataFrame, plain: bool = False) -> DataFrame:
    """Web-style queries as rows ``(query_id, alt, operand, negate, part, term)``.

    All operands of an alternative must match; ``or`` starts a new alternative;
    ``-`` negates an operand; quotes make a phrase, whose words are numbered by
    ``part``. With ``plain`` all words of the query are simply required.
    """
    text = fold("question")
    pattern = WORD if plain else '-?"[^"]*"|-?[^\\s"]+'
    pieces = unfold(
        queries.select("query_id", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("_all")),
        ["query_id", "_all"], "_all", "_at", "_piece",
    )
    is_or = F.col("_piece") == "or"
    alt = F.size(F.filter(F.slice("_all", 1, F.col("_at")), lambda p: p == "or"))
    if plain:
        is_or, alt = F.lit(False), F.lit(0)
    operands = pieces.filter(~is_or).select(
        "query_id", alt.cast("int").alias("alt"), F.col("_at").alias("operand"),
        F.col("_piece").startswith("-").alias("negate"),
        F.posexplode(F.regexp_extract_all("_piece", F.lit(WORD), F.lit(0))).alias("part", "term"),
    )
    return operands


def distinct_operands(terms: DataFrame) -> DataFrame:
    """Operands of an alternative that ask for the same words count once."""
    shaped = terms.groupBy("query_id", "alt", "operand", "negate").agg(
        F.array_sort(F.collect_list(F.struct("part", "term"))).alias("_shape")
    )
    once = shaped.groupBy("query_id", "alt", "negate", "_shape").agg(F.min("operand").alias("operand"))
    return once.select(
        "query_id", "alt", "operand", "negate", F.size("_shape").alias("_parts"), F.explode("_shape").alias("_s")
    ).select("query_id", "alt", "operand", "negate", "_parts", "_s.part", "_s.term")


def lexical_matches(chunks: DataFrame, terms: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``(query_id, alt, chunk_id, occurrences)`` of the chunks that satisfy an alternative.

    Candidates are found by counting distinct required terms; word positions
    are only read back for chunks that have all of them. Occurrences are the
    places where operands begin, in order, with the operands and running totals
    of words and inverse weights. An alternative with nothing but negations
    matches no chunk.
    """
    terms = distinct_operands(terms)
    index = index if index is not None else postings(chunks, terms)
    required = terms.filter(~F.col("negate")).select("query_id", "alt", "term").distinct()
    needed = required.groupBy("query_id", "alt").agg(F.count("*").alias("_needed"))
    candidates = (
        index.select("chunk_id", "term").join(required, "term")
        .groupBy("chunk_id", "query_id", "alt").agg(F.count("*").alias("_have"))
        .join(needed, ["query_id", "alt"]).filter("_have = _needed")
        .select("query_id", "alt", "chunk_id")
    )
    placed = candidates.join(terms, ["query_id", "alt"]).join(
        index.select("chunk_id", "term", "positions"), ["chunk_id", "term"]
    )
    return occurrences(placed, terms)


def occurrences(placed: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, alt, chunk_id, occurrences)`` of the candidates that satisfy an alternative.

    ``placed`` has a row for each candidate and word of an operand that stands in it, with its ``positions``.
    """
    group = ["query_id", "alt", "chunk_id"]
    starts = (
        placed.select(*group, "operand", "negate", "_parts", "part", F.explode("positions").alias("_p"))
        .groupBy(*group, "operand", "negate", "_parts", (F.col("_p.pos") - F.col("part")).alias("pos"))
        .agg(F.count("*").alias("_found"), F.min("_p.weight").alias("_weight"))
        .filter("_found = _parts")
    )
    barred = starts.filter("negate").select(*group).distinct()
    inverse = F.when(F.min("_weight") == "A", 1.0 / WEIGHTS["A"]).otherwise(1.0 / WEIGHTS["B"])
    places = starts.filter(~F.col("negate")).groupBy(*group, "pos").agg(
        F.collect_set("operand").alias("ops"), F.max("_parts").alias("words"), inverse.alias("inverse")
    )
    upto = Window.partitionBy(*group).orderBy("pos")
    numbered = places.select(
        *group,
        F.struct(
            F.row_number().over(upto).alias("at"), "pos", "ops", "words", "inverse",
            F.sum("words").over(upto).alias("words_upto"), F.sum("inverse").over(upto).alias("inverse_upto"),
        ).alias("_o"),
    )
    wanted = terms.filter(~F.col("negate")).groupBy("query_id", "alt").agg(F.count_distinct("operand").alias("_wanted"))
    return (
        numbered.groupBy(*group).agg(F.array_sort(F.collect_list("_o")).alias("occurrences"))
        .join(wanted, ["query_id", "alt"])
        .filter(F.size(F.array_distinct(F.flatten(F.transform("occurrences", lambda o: o["ops"])))) == F.col("_wanted"))
        .join(barred, group, "left_anti")
        .select(*group, "occurrences")
    )


def cover_density(occurrences: Column) -> Column:
    """Sum over the shortest stretches that hold every operand.

    A stretch counts with the harmonic mean of its words' weights, divided by
    one plus the number of other words inside it. One pass: the last place of
    each operand is kept, and what lies between two places follows from the
    running totals.
    """
    operands = F.array_distinct(F.flatten(F.transform(occurrences, lambda o: o["ops"])))

    def covers(names: Column) -> Column:
        def step(acc: Column, o: Column) -> Column:
            last = F.zip_with(
                names, acc["last"],
                lambda name, seen: F.when(F.array_contains(o["ops"], name), o["at"]).otherwise(seen),
            )
            return T.let(last, lambda seen: closed(acc, o, seen))

        def closed(acc: Column, o: Column, last: Column) -> Column:
            first = F.array_min(last)
            fresh = (first > 0) & (first > acc["first"])
            opening = F.get(occurrences, first - 1)
            inside = o["at"] - first + 1
            inverse = o["inverse_upto"] - opening["inverse_upto"] + opening["inverse"]
            words = o["words_upto"] - opening["words_upto"] + opening["words"]
            noise = F.greatest(F.lit(0), (o["pos"] + o["words"] - 1 - opening["pos"]) - (words - 1))
            return F.struct(
                last.alias("last"),
                F.when(fresh, first).otherwise(acc["first"]).alias("first"),
                F.when(fresh, acc["score"] + (inside / inverse) / (1.0 + noise)).otherwise(acc["score"]).alias("score"),
            )

        start = F.struct(
            F.transform(names, lambda _: F.lit(0)).alias("last"), F.lit(0).alias("first"), F.lit(0.0).alias("score")
        )
        return F.aggregate(occurrences, start, step, lambda acc: acc["score"])

    return T.let(operands, covers)


def lexical_topk(chunks: DataFrame, queries: DataFrame, k: int | None = 18, plain: bool = False,
                 index: DataFrame | None = None) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` of the best matching chunks by cover density."""
    return best_covers(lexical_matches(chunks, query_terms(queries, plain), index), k)


def best_covers(matched: DataFrame, k: int | None) -> DataFrame:
    """The best ``k`` chunks per query by cover density, or all of them; scores alike to nine places are ties."""
    scored = matched.select("query_id", "chunk_id", cover_density(F.col("occurrences")).alias("score"))
    best = scored.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    order = [F.desc(F.round("score", 9)), F.asc("chunk_id")]
    if k is None:
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return first_rows(best, ["query_id"], order, k, "rank")


def collection_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length in words."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.avg(F.size(words_of("content"))).alias("avg_len"))


def tasks_for(n_chunks: int, n_queries: int, least: int) -> int:
    """How many tasks share the pairs of chunks and queries, so that a task's memory does not grow with either."""
    return max(least, min(MOST_TASKS, -(-n_chunks * n_queries // PAIRS)))


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = 18,
              k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` by BM25 over any of a query's distinct words.

    Only words of some query leave the scan. They are laid out by chunk once, in
    as many tasks as the pairs of chunks and queries need: words are few bytes, but
    each meets all queries that ask for it. Counting terms and adding up scores per
    (query, chunk) happen in place, and each task gives out only its k best per query.
    """
    asked = cut_lineage(queries.select("query_id", F.explode(F.array_distinct(words_of("question"))).alias("term")))
    split = chunks.select("chunk_id", words_of("content").alias("_words")).withColumn("_len", F.size("_words"))
    # One pass for the words and the chunks: each chunk has a row without a word, too.
    held = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct("_words"), string_array([])))
    told = split.select("_len", F.explode_outer(held).alias("term")).groupBy("term").agg(
        F.count("*").alias("df"), F.avg("_len").alias("avg_len")
    )
    vocabulary = asked.select("term").distinct().withColumn("_asked", F.lit(True))
    frequency = cut_lineage(told.join(vocabulary, "term", "left").filter("_asked or term is null"))
    line = frequency.filter("term is null").first()
    n_chunks, avg_len = (line["df"], line["avg_len"] or 1.0) if line else (0, 1.0)
    weighted = cut_lineage(asked.join(frequency, "term").select(
        "query_id", "term",
        F.log(1 + (F.lit(n_chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
    ))
    sent = F.broadcast if weighted.count() <= SENT else (lambda df: df)
    tasks = tasks_for(n_chunks, queries.count(), chunks.sparkSession.sparkContext.defaultParallelism)
    lengths = unfold(split, ["chunk_id", "_len"], "_words", "_at", "term")
    counted = (
        lengths.join(sent(weighted.select("term").distinct()), "term", "left_semi").repartition(tasks, "chunk_id")
        .groupBy("chunk_id", "term", "_len").agg(F.count("*").alias("tf"))
    )
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("_len") / F.lit(avg_len))
    )
    scored = (
        counted.join(sent(weighted), "term").groupBy("chunk_id", "query_id")
        .agg(F.sum(part).alias("score")).select("query_id", "chunk_id", "score")
    )
    return first_rows(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("chunk_id")], k, "rank")
