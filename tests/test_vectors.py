"""Edge cases of vectors, exact search both ways, cells, embeddings and chunking."""

import random

from pyspark.sql import functions as F

from quaero.functions import sparse
from quaero.functions import vectors as V
from quaero.operators import chunking, dense


def test_unequal_null_and_zero_vectors(spark):
    rows = [(1, [1.0, 0.0], [0.0, 1.0]), (2, [1.0], [1.0, 2.0]), (3, None, [1.0, 2.0]), (4, [0.0, 0.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = {r.id: r for r in df.select("id", V.l2_distance(a, b).alias("l2"), V.cosine_similarity(a, b).alias("cos"), V.normalize(a).alias("unit")).collect()}
    assert abs(got[1].l2 - 2 ** 0.5) < 1e-9 and got[1].cos == 0
    assert got[2].l2 is None and got[3].l2 is None and got[4].cos is None
    assert got[4].unit == [0.0, 0.0]


def vectors(spark, n, seed, name):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def test_exact_search_both_ways(spark):
    chunks = vectors(spark, 300, 1, "chunk_id").unionByName(
        spark.createDataFrame([(900, None), (901, [0.0] * 8), (902, [1.0])], "chunk_id long, embedding array<float>")
    )
    queries = vectors(spark, 9, 2, "query_id")
    shown = lambda d: {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in d.collect()}
    sent, blocked = shown(dense.dense_topk(queries, chunks, 5)), shown(dense.dense_topk(queries, chunks, 5, broadcast_values=8))
    assert sent == blocked and len(sent) == 45
    first = queries.filter("query_id = 0").first().embedding
    plain = [(r.chunk_id, round(r.score, 6)) for r in dense.nearest(chunks, first, 5).collect()]
    assert plain == [(sent[0, i][0], round(sent[0, i][1], 6)) for i in range(1, 6)]


def test_cells_find_most_neighbours(spark):
    chunks, queries = vectors(spark, 400, 3, "chunk_id"), vectors(spark, 10, 4, "query_id")
    index = dense.CellIndex.build(chunks, cells=8)
    exact = dense.dense_topk(queries, chunks, 10)
    some = dense.recall(index.topk(queries, 10, probes=4), exact).agg(F.avg("recall")).first()[0]
    whole = dense.recall(index.topk(queries, 10, probes=8), exact).agg(F.min("recall")).first()[0]
    assert some > 0.6 and whole == 1.0


def greedy(sizes, size, overlap):
    """Chunks as (first, past), unit by unit."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > size:
            out.append((first, i))
            keep, kept = i - 1, sizes[i - 1]
            while keep > first and kept + sizes[keep - 1] <= overlap:
                keep -= 1
                kept += sizes[keep]
            first, total = (keep, kept) if overlap > 0 else (i, 0)
        total += n
    return out + [(first, len(sizes))] if sizes else []


def test_packing_against_a_loop(spark):
    rng = random.Random(9)
    cases = [[rng.choice([1, 5, 30, 90, 120, 400, 700]) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(cases)), "id long, sizes array<int>")
    for overlap in (100, 0):
        got = {r.id: [tuple(b) for b in r.b] for r in df.select("id", chunking.bounds(F.col("sizes"), 650, overlap).alias("b")).collect()}
        for i, sizes in enumerate(cases):
            assert got[i] == greedy(sizes, 650, overlap)


def test_units_and_overlap(spark):
    text = "Unu doi trei.\r\n\r\n\r\n" + " ".join(f"Propoziția {i} are cinci cuvinte." for i in range(200))
    df = spark.createDataFrame([(1, text)], "document_id long, content string")
    chunks = chunking.chunk_documents(df).orderBy("chunk_no").collect()
    assert chunks[0].content.startswith("Unu doi trei.\n\nPropoziția 0")
    assert len(chunks) > 1 and all(c.token_count <= 900 for c in chunks)
    assert chunks[1].content.split("\n\n")[0] in chunks[0].content


def test_embeddings_are_unit_vectors_in_batches(spark):
    df = spark.createDataFrame([(i, f"cuvânt {i} text") for i in range(120)] + [(120, "")], "id long, text string")
    made = chunking.embed(df, "text", batch=7)
    lengths = {round(r.n, 4) for r in made.select(V.norm(F.col("embedding")).alias("n")).collect()}
    assert lengths == {0.0, 1.0}


def test_sparse_vectors_are_merged_by_their_indices(spark):
    import math

    rng = random.Random(6)
    dims = 5_000_000_000

    def made():
        return {rng.choice([3, 9, 1_000_003, 4_999_999_999, rng.randint(1, dims)]): rng.choice([0.5, -2.0, 3.25]) for _ in range(rng.randrange(6))}

    pairs = [(made(), made()) for _ in range(200)]
    text = lambda d, n=dims: "{" + ",".join(f"{i}:{v}" for i, v in d.items()) + "}/" + str(n)
    rows = [(k, text(a), text(b)) for k, (a, b) in enumerate(pairs)]
    rows += [(900, "{1:1}/3", "{1:1}/4"), (901, "{5:1}/3", "{}/3"), (902, "{1:1,1:2}/3", "{}/3"), (903, "1:1/3", "{}/3"), (904, None, "{}/3"), (905, "{ 2 : 1e2 , 1:-.5 }/3", "{}/3")]
    df = spark.createDataFrame(rows, "id int, s string, t string").select("id", sparse.parse(F.col("s")).alias("a"), sparse.parse(F.col("t")).alias("b"))
    a, b = F.col("a"), F.col("b")
    got = {r.id: r for r in df.select(
        "id", a, sparse.inner_product(a, b).alias("ip"), sparse.l2_distance(a, b).alias("l2"), sparse.l1_distance(a, b).alias("l1"),
        sparse.cosine_distance(a, b).alias("cos"), sparse.norm(a).alias("norm"), sparse.to_text(sparse.normalize(a)).alias("unit"),
    ).collect()}
    for k, (x, y) in enumerate(pairs):
        both = set(x) | set(y)
        ip = sum(x.get(i, 0) * y.get(i, 0) for i in both)
        lengths = math.dist([0] * len(x), list(x.values())) * math.dist([0] * len(y), list(y.values()))
        assert math.isclose(got[k].ip, ip, abs_tol=1e-9) and math.isclose(got[k].l2, math.sqrt(sum((x.get(i, 0) - y.get(i, 0)) ** 2 for i in both)), abs_tol=1e-9)
        assert math.isclose(got[k].l1, sum(abs(x.get(i, 0) - y.get(i, 0)) for i in both), abs_tol=1e-9)
        assert got[k].cos is None if not lengths else math.isclose(got[k].cos, 1 - ip / lengths, abs_tol=1e-9)
        assert got[k].a.indices == sorted(x)
    assert got[900].ip is None and all(got[k].a is None for k in (901, 902, 903, 904)) and got[905].a.values == [-0.5, 100.0]
    dense_rows = spark.createDataFrame([(1, [0.0, 2.0, 0.0]), (2, None)], "id int, v array<float>").select(sparse.to_text(sparse.from_dense(F.col("v"))).alias("t"))
    assert [r.t for r in dense_rows.collect()] == ["{2:2.0}/3", None]


def test_a_sparse_text_is_read_once(spark):
    df = spark.createDataFrame([("{3:4,1:3}/9",)], "s string").select(sparse.normalize(sparse.parse(F.col("s"))).alias("u"))
    assert df.first().u == (9, [1, 3], [0.6, 0.8])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 1 and plan.count("regexp_extract_all(") <= 1
