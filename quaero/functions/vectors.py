"""Vector functions over ``array<float>`` columns.

Vectors of unequal length have no distance: every pairwise function is null for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def _pairwise(a: Column, b: Column, step) -> Column:
    return F.when(
        F.size(a) == F.size(b),
        _total(F.zip_with(a, b, lambda x, y: step(x.cast("double"), y.cast("double")))),
    )


def inner_product(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def l2_squared(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: (x - y) * (x - y))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1_distance(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: F.abs(x - y))


def dims(a: Column) -> Column:
    return F.size(a)


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalize(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length == 0, a).otherwise(
        F.transform(a, lambda x: (x.cast("double") / length).cast("float"))
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    lengths = norm(a) * norm(b)
    raw = inner_product(a, b) / F.nullif(lengths, F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)) + F.lit(0.0) * raw


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)


def spherical_distance(a: Column, b: Column) -> Column:
    """Angle between two unit vectors as a share of a half turn."""
    dot = inner_product(a, b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) / F.pi()


def subvector(a: Column, start: int, count: int) -> Column:
    """``count`` values from the 1-based position ``start``, cut off at both ends."""
    first = max(1, start)
    return F.slice(a, first, max(0, start + count - first))


def add(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x - y))


def multiply(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x * y))


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the first value that differs; a prefix comes first."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def binary_quantize(a: Column) -> Column:
    """One bit per value: is it above zero?"""
    return F.transform(a, lambda x: x > 0)


def _count(bits: Column) -> Column:
    return F.size(F.filter(bits, lambda b: b))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _count(F.zip_with(a, b, lambda x, y: x != y)))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 when the two share no set bit, also when neither has one."""
    both = _count(F.zip_with(a, b, lambda x, y: x & y))
    either = _count(F.zip_with(a, b, lambda x, y: x | y))
    return F.when(
        F.size(a) == F.size(b),
        F.when(both == 0, F.lit(1.0)).otherwise(1.0 - both / either),
    )


def pack_bits(bits: Column) -> Column:
    """Bits as ``array<bigint>`` words of 62, for ``hamming_packed``."""
    words = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 62).cast("int"))
    return F.when(F.size(bits) > 0, F.transform(
        words,
        lambda w: F.aggregate(
            F.slice(bits, w * 62 + 1, 62),
            F.lit(0).cast("bigint"),
            lambda acc, b: F.shiftleft(acc, 1) + b.cast("bigint"),
        ),
    )).otherwise(F.array().cast("array<bigint>"))


def hamming_packed(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0), lambda acc, n: acc + n,
    )


def to_vector(values: Column) -> Column:
    """Any numeric array as a vector."""
    return values.cast("array<float>")


def parse_vector(json_text: Column) -> Column:
    """A vector from its JSON text; null when empty or not an array of numbers."""
    parsed = F.from_json(json_text, "array<float>")
    return F.when(F.size(parsed) > 0, parsed)


def to_halfvec(a: Column) -> Column:
    """Values rounded to the 11 significant bits of a 16-bit float, ties to even."""

    def half(x: Column) -> Column:
        value = x.cast("double")
        power = F.greatest(F.floor(F.log2(F.nullif(F.abs(value), F.lit(0.0)))), F.lit(-14))
        unit = F.pow(F.lit(2.0), power - 10)
        rounded = F.rint(value / unit) * unit
        return F.coalesce(rounded, value).cast("float")

    return F.transform(a, half)


def to_sparse(a: Column) -> Column:
    """``map<int, float>`` of the values that are not zero, by 1-based position."""
    pairs = F.transform(a, lambda x, i: F.struct((i + 1).alias("key"), x.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] != 0))


def from_sparse(sparse: Column, dimensions: Column | int) -> Column:
    size = F.lit(dimensions) if isinstance(dimensions, int) else dimensions
    return F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.coalesce(F.try_element_at(sparse, i), F.lit(0.0).cast("float")),
    )
