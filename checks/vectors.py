"""Vector functions over the embeddings; every vector is compared with its successor."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import joined, query
from quaero.functions import sparse
from quaero.functions import vectors as V
from quaero.operators.vector_aggregates import avg_vectors, sum_vectors
from quaero.sources.tables import parse_embeddings

PAIRS_SQL = """pairs AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def pairs(t):
    a = t("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id")


def ab():
    return F.col("a"), F.col("b")
ZIP = "list_transform(range(1, len(a) + 1), lambda i: {x})"


def total(x: str) -> str:
    return f"list_sum({ZIP.format(x=x)})"


NORMS = "sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))"


@query("vector_distances", f"""
WITH {PAIRS_SQL} SELECT vec_id, round(sqrt({total('(a[i] - b[i]) ** 2')}), 6) AS l2, round({total('(a[i] - b[i]) ** 2')}, 6) AS l2_squared,
 round({total('a[i] * b[i]')}, 6) AS inner_product, round(-{total('a[i] * b[i]')}, 6) AS negative_inner,
 round({total('abs(a[i] - b[i])')}, 6) AS l1, round(1 - {total('a[i] * b[i]')} / ({NORMS}), 6) AS cosine,
 round(acos(greatest(-1, least(1, {total('a[i] * b[i]')}))) / pi(), 6) AS spherical FROM pairs""")
def _(t):
    A, B = ab()
    six = lambda c: F.round(c, 6)
    return pairs(t).select(
        "vec_id", six(V.l2_distance(A, B)).alias("l2"), six(V.l2_squared(A, B)).alias("l2_squared"),
        six(V.inner_product(A, B)).alias("inner_product"), six(V.negative_inner_product(A, B)).alias("negative_inner"),
        six(V.l1_distance(A, B)).alias("l1"), six(V.cosine_distance(A, B)).alias("cosine"),
        six(V.spherical_distance(A, B)).alias("spherical"),
    )


@query("vector_norms", f"""
WITH {PAIRS_SQL}, n AS (SELECT vec_id, a, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS n FROM pairs)
SELECT vec_id, len(a)::BIGINT AS dims, round(n, 6) AS norm, round(list_sum(list_transform(a, lambda x: x / n)), 5) AS unit_sum FROM n""")
def _(t):
    A, B = ab()
    unit = F.aggregate(V.normalize(F.transform(A, lambda x: x * 3)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return pairs(t).select(
        "vec_id", V.dims(A).cast("long").alias("dims"), F.round(V.norm(A), 6).alias("norm"), F.round(unit, 5).alias("unit_sum")
    )


TEXT = "array_to_string(list_transform({v}, lambda x: round(x, 5)::DECIMAL(18, 5)::VARCHAR), ' ')"


def shown(c):
    return joined(F.transform(c, lambda x: F.round(x.cast("double"), 5).cast("decimal(18,5)").cast("string")), " ")


@query("vector_arithmetic", f"""
WITH {PAIRS_SQL} SELECT vec_id, round({total('(a[i]::FLOAT + b[i]::FLOAT)::DOUBLE')}, 4) AS added, round({total('(a[i]::FLOAT - b[i]::FLOAT)::DOUBLE')}, 4) AS subtracted,
 round({total('(a[i]::FLOAT * b[i]::FLOAT)::DOUBLE')}, 4) AS multiplied, len(list_concat(a, b))::BIGINT AS concatenated,
 {TEXT.format(v='a[3:7]')} AS part, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END::BIGINT AS compared FROM pairs""")
def _(t):
    A, B = ab()
    tot = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    return pairs(t).select(
        "vec_id", tot(V.add(A, B)).alias("added"), tot(V.subtract(A, B)).alias("subtracted"),
        tot(V.multiply(A, B)).alias("multiplied"), V.dims(V.concat(A, B)).cast("long").alias("concatenated"),
        shown(V.subvector(A, 3, 5)).alias("part"), V.compare(A, B).cast("long").alias("compared"),
    )


@query("vector_bits", f"""
WITH {PAIRS_SQL}, bits AS (SELECT vec_id, list_transform(a, lambda x: x > 0) AS a, list_transform(b, lambda x: x > 0) AS b FROM pairs),
c AS (SELECT vec_id, a, {total('(a[i] <> b[i])::INT')} AS hamming, {total('(a[i] AND b[i])::INT')} AS both_set, {total('(a[i] OR b[i])::INT')} AS any_set FROM bits)
SELECT vec_id, array_to_string(list_transform(a, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS bits, hamming::BIGINT AS hamming, hamming::BIGINT AS hamming_packed,
 round(CASE WHEN both_set = 0 THEN 1.0 ELSE 1 - both_set / any_set::DOUBLE END, 6) AS jaccard FROM c""")
def _(t):
    A, B = ab()
    rows = pairs(t).select("vec_id", V.binary_quantize(A).alias("a"), V.binary_quantize(B).alias("b"))
    return rows.select(
        "vec_id", joined(F.transform("a", lambda x: F.when(x, "1").otherwise("0")), "").alias("bits"),
        V.hamming_distance(A, B).cast("long").alias("hamming"),
        V.hamming_packed(V.pack_bits(A), V.pack_bits(B)).cast("long").alias("hamming_packed"),
        F.round(V.jaccard_distance(A, B), 6).alias("jaccard"),
    )


@query("vector_aggregates", """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
SELECT label::BIGINT AS label, pos::BIGINT AS pos, round(avg(v), 6) AS mean, round(sum(v), 5) AS total, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def _(t):
    mean = avg_vectors(t("embeddings"), ["label"], "embedding").select("label", "n", F.posexplode("embedding").alias("pos", "mean"))
    added = sum_vectors(t("embeddings"), ["label"], "embedding").select("label", F.posexplode("embedding").alias("pos", "total"))
    return mean.join(added, ["label", "pos"]).select(
        F.col("label").cast("long"), (F.col("pos") + 1).cast("long").alias("pos"), F.round("mean", 6).alias("mean"),
        F.round("total", 5).alias("total"), "n",
    )


@query("vector_casts", f"""
WITH {PAIRS_SQL} SELECT vec_id, len(list_filter(a, lambda x: round(x, 1) <> 0))::BIGINT AS stored, len(a)::BIGINT AS dims,
 round(list_sum(list_transform(a, lambda x: round(x, 1))), 4) + 0.0 AS back FROM pairs""")
def _(t):
    A, B = ab()
    rough = F.transform(A, lambda x: F.round(x.cast("double"), 1).cast("decimal(6,1)"))
    rows = pairs(t).select("vec_id", V.dims(A).alias("d"), V.to_sparse(V.to_vector(rough)).alias("s"))
    back = V.from_sparse(F.col("s"), F.col("d"))
    return rows.select(
        "vec_id", F.size("s").cast("long").alias("stored"), V.dims(back).cast("long").alias("dims"),
        (F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x.cast("double")), 4) + 0.0).alias("back"),
    )


@query("vector_half_precision", f"""
WITH {PAIRS_SQL}, h AS (SELECT vec_id, a, list_transform(a, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / 2 ** (greatest(floor(log2(abs(x))), -14) - 10), 0) * 2 ** (greatest(floor(log2(abs(x))), -14) - 10) END) AS h FROM pairs)
SELECT vec_id, {TEXT.format(v='h')} AS half FROM h""")
def _(t):
    A, B = ab()
    return pairs(t).select("vec_id", shown(V.to_halfvec(A)).alias("half"))


@query("vector_from_json", """
SELECT vec_id AS chunk_id, len(embedding)::BIGINT AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total
FROM embeddings WHERE vec_id % 10 NOT IN (0, 1)""")
def _(t):
    kind = F.col("vec_id") % 10
    stored = F.when(kind == 1, "[]").when(kind != 0, F.to_json("embedding"))
    rows = t("embeddings").select(F.col("vec_id").alias("chunk_id"), stored.alias("embedding"))
    return parse_embeddings(rows).select(
        "chunk_id", V.dims(F.col("embedding")).cast("long").alias("dims"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"),
    )


# An order as a sparse vector over forty million places: its parts' places and quantities. Neighbouring orders are compared.
SPARSE_SQL = """
cells AS (SELECT l_orderkey AS id, (l_partkey % 40) * 1000003 + 1 AS i, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(v * v)) AS n FROM cells GROUP BY id),
pairs AS (SELECT a.id AS left_id, b.id AS right_id, a.n AS left_norm, b.n AS right_norm FROM norms a JOIN norms b ON b.id = a.id + 1),
sides AS (SELECT left_id, i, v AS x, 0.0::DOUBLE AS y FROM pairs JOIN cells ON id = left_id UNION ALL SELECT left_id, i, 0, v FROM pairs JOIN cells ON id = right_id),
merged AS (SELECT left_id, i, sum(x) AS x, sum(y) AS y FROM sides GROUP BY ALL),
told AS (SELECT left_id, sum(x * y) AS ip, sqrt(sum((x - y) * (x - y))) AS l2, sum(abs(x - y)) AS l1 FROM merged GROUP BY 1)"""


@query("sparse_distances", f"""
WITH {SPARSE_SQL} SELECT left_id, round(ip, 6) AS inner_product, round(-ip, 6) AS negative_inner_product, round(l2, 6) AS l2_distance, round(l1, 6) AS l1_distance,
  round(1 - ip / left_norm / right_norm, 6) AS cosine_distance, round(left_norm, 6) AS norm FROM told JOIN pairs USING (left_id)""")
def _(t):
    place = (F.col("l_partkey") % 40) * 1_000_003 + 1
    pair = F.struct(place.alias("index"), F.col("l_quantity").cast("double").alias("value"))
    vectors = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        sparse.of_pairs(F.lit(40 * 1_000_003), F.collect_list(pair)).alias("v")
    )
    both = vectors.select(F.col("id").alias("left_id"), F.col("v").alias("a")).join(
        vectors.select((F.col("id") - 1).alias("left_id"), F.col("v").alias("b")), "left_id"
    )
    a, b = F.col("a"), F.col("b")
    told = {
        "inner_product": sparse.inner_product(a, b), "negative_inner_product": sparse.negative_inner_product(a, b),
        "l2_distance": sparse.l2_distance(a, b), "l1_distance": sparse.l1_distance(a, b),
        "cosine_distance": sparse.cosine_distance(a, b), "norm": sparse.norm(a),
    }
    return both.select("left_id", *[F.round(c, 6).alias(name) for name, c in told.items()])


@query("sparse_normalized", f"""
WITH {SPARSE_SQL} SELECT id, count(*)::BIGINT AS entries, round(sum(v / n), 6) AS total, max(i) AS last_index FROM cells JOIN norms USING (id) GROUP BY id""")
def _(t):
    place = (F.col("l_partkey") % 40) * 1_000_003 + 1
    cell = t("lineitem").groupBy(F.col("l_orderkey").alias("id"), place.alias("i")).agg(F.sum("l_quantity").alias("v"))
    text = F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat_ws(":", F.col("i").cast("string"), F.col("v").cast("string"))), ","), F.lit("}/40000120"))
    unit = cell.groupBy("id").agg(text.alias("t")).select("id", sparse.normalize(sparse.parse(F.col("t"))).alias("u"))
    return unit.select(
        "id", F.size("u.indices").cast("long").alias("entries"), F.round(F.aggregate("u.values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
        F.array_max("u.indices").alias("last_index"),
    )
