"""Ordered and substring operators against plain Python, with one key that owns most rows."""

import datetime
import random

from pyspark.sql import functions as F

from quaero.operators import keyed, selection


def rows_with_hot_key(n=400):
    rng = random.Random(3)
    out, at = [], 0
    for _ in range(n):
        at += rng.randint(1, 9)
        out.append((rng.choice(["hot"] * 6 + ["a", "b"]), at, rng.choice([None, None, f"v{at}"])))
    return out


def test_carry_forward(spark):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "key string, at long, value string")
    for width in (7, 10_000):
        for current in (False, True):
            got = {
                (r.key, r.at): r.last
                for r in keyed.carry_forward(df, ["key"], "at", F.col("value"), "last", current, width).collect()
            }
            last, wanted = {}, {}
            for key, at, value in rows:
                if current and value is not None:
                    last[key] = value
                wanted[key, at] = last.get(key)
                if value is not None:
                    last[key] = value
            assert got == wanted


def test_running_rank(spark):
    rows = [(k, i % 3, i) for i, (k, _, _) in enumerate(rows_with_hot_key())]
    df = spark.createDataFrame(rows, "key string, level int, seq long")
    got = {r.seq: r.place for r in keyed.running_rank(df, ["key"], ["level"], "seq", "place", 11).collect()}
    wanted = {}
    for key in {r[0] for r in rows}:
        for place, (_, seq) in enumerate(sorted((lv, s) for k, lv, s in rows if k == key), 1):
            wanted[seq] = place
    assert got == wanted


def test_asof_join(spark):
    rng = random.Random(8)
    start = datetime.datetime(2026, 1, 1)
    at = lambda: start + datetime.timedelta(seconds=rng.randint(0, 300_000))
    left = [(i, rng.choice("aab"), at()) for i in range(80)]
    right = [(rng.choice("aab"), at(), i) for i in range(60)]
    right.append((left[0][1], left[0][2], 999))
    joined = keyed.asof_join(
        spark.createDataFrame(left, "id long, key string, asked timestamp"),
        spark.createDataFrame(right, "key string, told timestamp, n long"),
        ["key"], "asked", "told", "prior",
    )
    got = {r.id: (r.prior.n if r.prior else None) for r in joined.collect()}
    for i, key, asked in left:
        before = [(t, n) for k, t, n in right if k == key and t <= asked]
        assert got[i] in ({n for t, n in before if t == max(before)[0]} if before else {None})
    assert got[0] == 999


def test_contains_join_with_few_and_many_seeds(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate(["abcdefgh", "xxabcdxx", "éèàçabcdé", "", "abc", "line\nabcde\nend"])]
    needles = [(i, n) for i, n in enumerate(["abcd", "abcde", "çabc", "e\nab", "zzzz", "line\nabc"])]
    wanted = {(i, j) for i, t in texts for j, n in needles if n in t}
    t = spark.createDataFrame(texts, "i long, text string")
    n = spark.createDataFrame(needles, "j long, needle string")
    for limit in (keyed.MAX_SEEDS, 0):
        monkeypatch.setattr(keyed, "MAX_SEEDS", limit)
        got = [(r.i, r.j) for r in keyed.contains_join(t, "text", n, "needle").collect()]
        assert sorted(got) == sorted(wanted)


def test_asof_join_spreads_a_hot_hour_over_runs(spark):
    """A third of all events of one key in one hour: no run holds much more than its share."""
    rng = random.Random(9)
    start = datetime.datetime(2026, 1, 1)
    at = lambda hot: start + datetime.timedelta(milliseconds=rng.randint(0, 3_600_000 if hot else 400_000_000))
    left = [(i, "hot" if i % 3 else f"k{i % 40}", at(i % 3)) for i in range(1500)]
    right = [("hot" if i % 3 else f"k{i % 40}", at(i % 3), i) for i in range(1500)]
    joined = keyed.asof_join(
        spark.createDataFrame(left, "id long, key string, asked timestamp"), spark.createDataFrame(right, "key string, told timestamp, n long"),
        ["key"], "asked", "told", "prior",
    )
    got = {r.id: (r.prior.told if r.prior else None) for r in joined.collect()}
    told = {}
    for k, t, _ in right:
        told.setdefault(k, []).append(t)
    assert got == {i: max((t for t in told.get(k, []) if t <= a), default=None) for i, k, a in left}


def test_ranked_values_are_those_of_sorted_lists(spark):
    rng = random.Random(10)
    values = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [5.0] * 900, "c": [rng.choice([-1e308, 1e308, 0.0, 1e-300]) for _ in range(500)],
              None: [float(i) for i in range(100)], "d": [1.0], "e": [rng.random() ** 40 for _ in range(2000)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("f", None)]
    ranks = [(k, r) for k, vs in values.items() for r in {0, len(vs) // 2, len(vs) - 1, len(vs), 7, 450}] + [("f", 0), ("g", 0)]
    df = spark.createDataFrame(rows, "key string, v double")
    for bins, most in ((1024, 4096), (16, 10)):
        found = selection.ranked_values(df, ["key"], "v", spark.createDataFrame(ranks, "key string, rank long"), bins, most)
        got = {(r.key, r["rank"]): r.value for r in found.collect()}
        assert got == {(k, r): sorted(values[k])[r] for k, r in ranks if k in values and r < len(values[k])}
