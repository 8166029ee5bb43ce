"""Sparse vectors: ``struct(dims, indices, values)`` with ascending indices from 1, never laid out in full.

Two vectors are merged by their indices; vectors of different ``dims`` have no distance: functions of two give null for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaero.functions import text as T

KIND = "struct<dims:bigint,indices:array<bigint>,values:array<double>>"


def of_pairs(dims: Column, pairs: Column) -> Column:
    """From ``array<struct(index, value)>``: values of one index are added up, zeros left out."""
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(p["index"].cast("long").alias("i"), p["value"].cast("double").alias("v"))))

    def add(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(done, F.array(p))
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(p["i"].alias("i"), (last["v"] + p["v"]).alias("v"))))
        return F.when(F.size(done) == 0, F.array(p)).otherwise(F.when(last["i"] == p["i"], merged).otherwise(longer))

    summed = F.filter(F.aggregate(ordered, F.array().cast("array<struct<i:bigint,v:double>>"), add), lambda p: p["v"] != 0)
    return T.let(summed, lambda once: F.struct(dims.cast("long").alias("dims"), once["i"].alias("indices"), once["v"].alias("values")).cast(KIND))


def parse(text: Column) -> Column:
    """From the text form ``{1:0.5,7:2}/10``; null if it is not of that form or an index is out of range."""
    number = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    shape = r"^\{(?:[0-9]+:%s(?:,[0-9]+:%s)*)?\}/[0-9]+$" % (number, number)

    def read(plain: Column) -> Column:
        entries = F.regexp_extract_all(plain, F.lit(r"([0-9]+):([^,}]+)"), F.lit(0))
        pairs = F.transform(entries, lambda e: F.struct(
            F.substring_index(e, ":", 1).try_cast("long").alias("index"), F.substring_index(e, ":", -1).try_cast("double").alias("value")
        ))
        told = F.struct(F.regexp_extract(plain, r"/([0-9]+)$", 1).try_cast("long").alias("dims"), pairs.alias("pairs"))
        return F.when(plain.rlike(shape), T.let(told, made))

    def made(told: Column) -> Column:
        dims, pairs = told["dims"], told["pairs"]
        inside = F.forall(pairs, lambda p: (p["index"] >= 1) & (p["index"] <= dims))
        unique = F.size(F.array_distinct(F.transform(pairs, lambda p: p["index"]))) == F.size(pairs)
        return F.when(inside & unique, of_pairs(dims, pairs))

    return T.let(F.regexp_replace(text, r"\s+", ""), read)


def to_text(a: Column) -> Column:
    shown = F.zip_with(a["indices"], a["values"], lambda i, v: F.concat_ws(":", i.cast("string"), v.cast("string")))
    return F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}/"), a["dims"].cast("string"))


def from_dense(a: Column) -> Column:
    pairs = F.transform(a, lambda v, i: F.struct((i + 1).cast("long").alias("index"), v.cast("double").alias("value")))
    return F.when(a.isNotNull(), of_pairs(F.size(a), pairs))


def _merged(a: Column, b: Column, part) -> Column:
    """The sum of ``part(x, y)`` over all indices that either vector has, by merging their entries."""
    entry = lambda x, y: lambda i, v: F.struct(i.alias("i"), x(v).alias("x"), y(v).alias("y"))
    mine, none = (lambda v: v.cast("double")), (lambda v: F.lit(0.0))
    both = F.array_sort(F.concat(
        F.zip_with(a["indices"], a["values"], entry(mine, none)), F.zip_with(b["indices"], b["values"], entry(none, mine))
    ))

    def step(acc: Column, e: Column) -> Column:
        same = e["i"] == acc["i"]
        return F.struct(
            e["i"].alias("i"),
            F.when(same, acc["x"] + e["x"]).otherwise(e["x"]).alias("x"), F.when(same, acc["y"] + e["y"]).otherwise(e["y"]).alias("y"),
            F.when(same, acc["total"]).otherwise(acc["total"] + part(acc["x"], acc["y"])).alias("total"),
        )

    start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("total"))
    return F.when(a["dims"] == b["dims"], F.aggregate(both, start, step, lambda acc: acc["total"] + part(acc["x"], acc["y"])))


def inner_product(a: Column, b: Column) -> Column:
    return _merged(a, b, lambda x, y: x * y)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def l2_squared(a: Column, b: Column) -> Column:
    return _merged(a, b, lambda x, y: (x - y) * (x - y))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1_distance(a: Column, b: Column) -> Column:
    return _merged(a, b, lambda x, y: F.abs(x - y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a["values"], F.lit(0.0), lambda acc, v: acc + v * v))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null for a vector without entries."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b) / lengths)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def normalize(a: Column) -> Column:
    """The vector at length one; one without entries stays as it is."""

    def scaled(x: Column, length: Column) -> Column:
        values = F.transform(x["values"], lambda v: v / length)
        return F.when(length == 0, x).otherwise(F.struct(x["dims"].alias("dims"), x["indices"].alias("indices"), values.alias("values")).cast(KIND))

    return T.let(a, lambda x: T.let(norm(x), lambda length: scaled(x, length)))
