"""Hard negatives against brute force and SQL: nulls, ties, repeated rows, mixed widths, huge components; intervals that hold."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, rows_of
from quaero.llm import hard_negatives, queries, sql

SCHEMA = "vec_id long, label int, embedding array<double>, row long, item string, code int, v string"
MOST = (1 << 63) - 1


def hard_rows():
    rng = random.Random(4)
    unit = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    base = unit(12)
    rows = [(i, rng.choice([0, 1, 2, None]), [b + rng.gauss(0, 0.4) for b in base]) for i in range(160)]
    rows += [(200 + i, i % 3, unit(5)) for i in range(60)] + [(300, 1, []), (301, 1, []), (350, 2, [])]
    rows += [(400, 1, base), (400, 1, base), (401, 1, base), (402, 2, base), (402, 2, base), (450, 2, base)]
    rows += [(500, 1, None), (501, 1, [None] * 12), (502, 1, [float("nan")] * 12), (503, 1, [float("inf")] + [0.0] * 11), (None, 1, base), (None, 2, base), (550, 1, [0.0] * 12)]
    return rows


def brute(rows):
    taken = [
        (i, None if label is None else (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v])
        for i, label, v in rows
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for a, (anchor, label, v) in enumerate(taken):
        if anchor is None or anchor % 50:
            continue
        clip = lambda s: max(-MOST, min(MOST, s))
        scored = [
            (-clip(sum(x * y for x, y in zip(v, w))), float("inf") if i is None else i, other == label)
            for r, (i, other, w) in enumerate(taken) if r != a and len(w) == len(v)
        ]
        for s, p, _ in sorted(x for x in scored if x[2])[:5]:
            found = sorted(x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            known = lambda i: None if i == float("inf") else i
            out += [(anchor, known(p), k, known(n), -s, -t) for k, (t, n, _) in enumerate(found, 1)]
    return out


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, label, v, 1, "x", 2, "y") for i, label, v in rows], SCHEMA).repartition(5)
    return hard_negatives.mine(hard_negatives.with_shifted_labels(df), F.col("vec_id") % 50 == 0, **how)


def test_hard_cases(spark):
    rows = hard_rows()
    found = sorted(map(tuple, mined(spark, rows).collect()), key=repr)
    assert found == sorted(brute(rows), key=repr) and len(found) > 30


def test_anchors_in_several_blocks(spark):
    rows = hard_rows()
    assert sorted(map(tuple, mined(spark, rows, block_values=30).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_components_beyond_exact_doubles(spark):
    rng = random.Random(8)
    rows = [(i, i % 2, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 9, 15]) for _ in range(3)]) for i in range(120)]
    assert sorted(map(tuple, mined(spark, rows).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_empty_tables(spark):
    rows = hard_rows()
    assert mined(spark, rows).limit(0).collect() == []
    assert mined(spark, []).collect() == []
    assert mined(spark, [r for r in rows if r[0] is not None and r[0] % 50]).collect() == []


def test_intervals_hold_and_leave_out_what_is_far():
    rng = np.random.default_rng(3)
    for width in (1, 3, 64, 100, 512):
        centres = rng.normal(size=(40, width))
        vectors = np.floor(256 * (np.repeat(centres, 20, axis=0) + rng.normal(size=(800, width)) * 0.25))
        code, along, rest = hard_negatives.codes(vectors)
        lower, upper = hard_negatives.Planes.of(vectors[:100]).intervals(code, along, rest)
        scores = vectors[:100] @ vectors.T
        assert (lower <= scores).all() and (scores <= upper).all()
        if width == 512:
            tenth = np.sort(scores, axis=1)[:, -10]
            assert (upper >= tenth[:, None]).mean() < 0.1


def test_equals_sql(spark, tmp_path):
    # SQL has no order for rows without number, and takes only lists of one width of numbers that doubles hold.
    rows = [r for r in hard_rows() if r[0] is not None and (r[2] is None or len(r[2]) == 12)]
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int32()),
                      "embedding": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})
    pq.write_table(table, f"{tmp_path}/embeddings.parquet")
    df = queries.QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    con = duckdb.connect()
    con.register("embeddings", table)
    done = con.execute(sql.HARD_NEGATIVES)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in done.description], done.fetchall())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_registered_query_equals_sql(spark, folder):
    name = "op12_hard_negatives"
    assert compare(spark, f"/root/testdata/{folder}", name, queries.QUERIES[name], queries.ORACLE[name]).startswith("ok")
