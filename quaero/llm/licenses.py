"""License scan: an exact set-similarity join of text blocks (lines, and runs of words over them) with license templates.

Tokens are ordered by their count in the whole corpus, rarest first. A block that holds at least ``threshold`` of a template's
tokens must share one of the template's first tokens (prefix filter), have enough tokens (length filter), and have enough of
them left at the shared token in either list (positional filter); what passes is counted exactly. Texts that hold enough of a
template's tokens at all are also read in runs of twice the template's words, whatever lines these stand in.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions.text import let
from quaero.llm.common import ascii_lower, numbered

# What separates words: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base labels and sentences of public license notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_tokens(text: str) -> list[str]:
    return sorted(set(template_words(text)))


def needed(size: int, threshold: float) -> int:
    """The fewest shared tokens that make ``threshold`` of a template of ``size`` tokens."""
    return max(1, math.ceil(threshold * size - 1e-9))


def lowered(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def words_of(text: Column) -> Column:
    """The words of ``lowered`` text, cut at what lies between them: ``regexp_extract_all`` makes an object for each word."""
    return F.array_remove(F.split(text, BETWEEN), "")


def line_words(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, lines (the words of each line), words (of the whole text)."""
    lines = F.transform(F.split(lowered(F.col("text")), "\n"), words_of)
    return (
        numbered(docs.select("doc_id", "text"))
        .select("row_id", "doc_id", lines.alias("lines"))
        .withColumn("words", F.flatten("lines"))
    )


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template tokens, rarest in the documents first. Their number is that of the templates, not of the documents."""
    spark = docs.sparkSession
    terms = spark.createDataFrame([(t,) for t in vocabulary], "token string")
    counted = (
        docs.select(F.explode_outer(words_of(lowered(F.col("text")))).alias("token"))
        .join(F.broadcast(terms), "token")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n = {r.token: r.n for r in counted.collect()}
    return sorted(vocabulary, key=lambda t: (n.get(t, 0), t))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Where the words of ``phrase`` stand in a row, as positions from 0."""
    parts = phrase.split()

    def here(i):
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found &= F.get(words, i + k) == part
        return found

    last = F.size(words) - len(parts)
    spots = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)
    return F.when((last >= 0) & F.array_contains(words, parts[-1]), spots).otherwise(F.array().cast("array<int>"))


def in_runs(words: Column, held: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """label, part of each template of which a run of twice its words holds ``threshold`` of the tokens; ``held`` are the
    template tokens among ``words``."""

    def one(label: str, text: str) -> Column:
        tokens = template_tokens(text)
        known = F.array(*[F.lit(t) for t in tokens])
        shared = lambda i: F.size(F.array_intersect(F.slice(words, i + 1, 2 * len(template_words(text))), known))
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(known, F.get(words, i)))
        need = needed(len(tokens), threshold)
        found = let(F.array_max(F.transform(starts, shared)), lambda n: F.when(n >= need, F.struct(F.lit(label).alias("label"), (n / len(tokens)).alias("part"))))
        return F.when(F.size(F.array_intersect(held, known)) >= need, found)

    found = F.array(*[one(label, text) for label, text in templates]).cast("array<struct<label:string,part:double>>")
    return F.array_compact(found)


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8
) -> DataFrame:
    """One row per document: phrase places, labels and the best containment of a template in one of its lines or runs.

    docs: doc_id, text; other columns are not read. Null and empty texts have no words: counts 0, no places, empty labels,
    score 0. A document with a phrase scores 1, one with a template the largest part of a template's tokens found in a line
    or a run.
    Repeated rows give a row each; an empty table gives none.
    """
    spark = docs.sparkSession
    sets = [(i, label, template_tokens(text)) for i, (label, text) in enumerate(templates)]
    order = token_order(docs, sorted({t for _, _, tokens in sets for t in tokens}))
    rank = {t: k + 1 for k, t in enumerate(order)}
    prefixes = []
    for i, label, tokens in sets:
        ranks = sorted(rank[t] for t in tokens)
        need = needed(len(ranks), threshold)
        prefixes += [(order[r - 1], r, i, label, at, need, ranks) for at, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefix = spark.createDataFrame(prefixes, "token string, rank int, template int, label string, at int, need int, ranks array<int>")
    starts = F.array(*[F.lit(t) for t in sorted({p[0] for p in prefixes})]).cast("array<string>")
    ordered = F.array(*[F.lit(t) for t in order]).cast("array<string>")
    least = min((p[5] for p in prefixes), default=1)

    places = {p: f"place_{k}" for k, p in enumerate(phrases)}
    based = line_words(docs).select(
        "row_id", "doc_id", "lines", F.size("words").cast("long").alias("n_words"),
        *[phrase_starts(F.col("words"), p).alias(c) for p, c in places.items()],
        let(F.array_intersect("words", ordered), lambda held: in_runs(F.col("words"), held, templates, threshold)).alias("runs"),
    )
    every = F.flatten(F.array(*[F.col(c) for c in places.values()]))
    labels = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(phrases[p])) for p, c in places.items()]))
    based = based.select(
        "row_id", "doc_id", "lines", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.col("runs.label"))).alias("run_labels"), F.array_max("runs.part").alias("run_part"),
    )
    doc = ["row_id", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "run_labels", "run_part"]
    blocks = based.select(*doc, F.posexplode_outer("lines").alias("line", "words")).select(
        *doc, "line", F.when(F.size("words") >= least, F.array_distinct("words")).alias("block")
    )
    shared = blocks.select(*doc, "line", "block", F.explode_outer(F.array_intersect("block", starts)).alias("token"))
    in_order = F.array_sort(F.transform(F.array_intersect("block", ordered), lambda t: F.array_position(ordered, t).cast("int")))
    candidates = (
        shared.join(F.broadcast(prefix), "token", "left")
        .filter(F.col("template").isNotNull() | F.col("line").isNull() | (F.col("line") == 0))
        .withColumn("block_ranks", F.when(F.col("template").isNotNull() & (F.size("block") >= F.col("need")), in_order))
    )
    left_in_block = F.size("block_ranks") - F.array_position("block_ranks", F.col("rank")) + 1
    possible = F.least(left_in_block, F.size("ranks") - F.col("at")) >= F.col("need")
    shared_tokens = F.when(possible, F.size(F.array_intersect("block_ranks", "ranks")))
    contained = F.when(F.col("overlap") >= F.col("need"), F.col("overlap") / F.size("ranks"))
    return (
        candidates.withColumn("overlap", shared_tokens)
        .select(*doc, contained.alias("part"), F.when(F.col("overlap") >= F.col("need"), F.col("label")).alias("label"))
        .groupBy(*doc)
        .agg(F.collect_set("label").alias("found"), F.max("part").alias("part"))
        .select(
            "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(F.array_union("base_labels", "run_labels"), "found")), ",").alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.greatest("part", "run_part"), F.lit(0.0))).alias("score"),
        )
    )
