"""Periodic runs and SimHash links against brute force, on hard cases and on a folder of tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from quaero.llm import periodic_runs, queries, simhash

CASES = [
    (1, "a b c " * 20), (2, None), (3, ""), (4, " \n\t"), (5, "x " * 5), (6, "x " * 6), (7, "a a a a a a b a a a a a a"), (8, "one two three"),
    (8, "one two three"), (None, "one two three"), (9, "p q " * 3 + "p"), (10, "p q " * 4), (11, "start " + "l m n o " * 4 + "l end"),
    (12, "x y x y x y x y x y z x y x y x y x y"), (13, "long " * 70_000 + "tail"), (14, "A b\x0bC\x1cd e A b C\x1cd e"),
]


def brute_runs(words):
    found = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                found.add((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest_of(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words) if n < 3000 else periodic_runs.find_runs([w.encode() for w in words])
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def documents(spark, rows):
    kind = "doc_id long, text string, runs string, words string, key long, fingerprint string, first int"
    return spark.createDataFrame([(d, t, "x", "y", 1, "z", 2) for d, t in rows], kind)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_lyndon_words_and_groups():
    rng = random.Random(5)
    for _ in range(500):
        word = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(13))]
        for inverse in (False, True):
            length, group = periodic_runs.lyndon_groups(word, inverse)
            key = [-x for x in word] if inverse else word
            prefixes = []
            for i in range(len(word)):
                lyndon = [j for j in range(i + 1, len(word) + 1) if all(key[i:j] < key[k:j] for k in range(i + 1, j))]
                assert length[i] == max(lyndon) - i
                prefixes.append(tuple(word[i : i + length[i]]))
            assert len(set(prefixes)) == len(set(group.tolist())) == len(set(zip(prefixes, group.tolist())))


def test_runs_of_random_words():
    rng = random.Random(6)
    for _ in range(1500):
        words = []
        while len(words) < rng.randrange(60):
            block = [rng.randrange(rng.choice([1, 2, 30])) for _ in range(rng.randrange(1, 9))]
            words += block * rng.choice([1, 1, 2, 4, 5, 6]) + block[: rng.randrange(len(block))]
        words = [b"%d" % x for x in words]
        assert periodic_runs.find_runs(words) == brute_runs(words)


def test_runs_of_long_texts_take_linear_time():
    for period in (1, 7, 3000):
        assert periodic_runs.find_runs([b"%d" % (i % period) for i in range(200_000)]) == [(0, 200_000, period)]


def test_periodic_runs_of_hard_cases(spark):
    docs = documents(spark, CASES)
    found = periodic_runs.digest(periodic_runs.with_planted_runs(docs)).collect()
    assert ordered(found) == ordered(digest_of(d, t) for d, t in CASES)
    assert periodic_runs.digest(periodic_runs.with_planted_runs(docs.limit(0))).collect() == []


def test_periodic_runs_of_documents(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    assert ordered(queries.QUERIES["op11_periodic_runs"](spark, sf_dir).collect()) == ordered(digest_of(d, t) for d, t in rows)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    """The smallest of the fingerprints that links reach, for each."""
    marks = sorted(set(marks))
    table, left, root = np.array(marks, dtype=np.uint64), set(range(len(marks))), {}
    for first in range(len(marks)):
        todo = [first] if first in left else []
        while todo:
            at = todo.pop()
            if at in left:
                left.discard(at)
                root[marks[at]] = marks[first]
                todo += np.flatnonzero(np.bitwise_count(table[at] ^ table) <= 3).tolist()
    return root


def brute_near(rows):
    marks = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(marks)
    least = {}
    for (d, _), m in zip(rows, marks):
        if d is not None:
            least[root[m]] = min(d, least.get(root[m], d))
    return [(d, f"{m:016x}", least.get(root[m])) for (d, _), m in zip(rows, marks)]


def test_simhash_of_hard_cases(spark):
    text = " ".join(f"w{i * i % 391}" for i in range(300))
    rows = [(d, t) for d, t in CASES if d != 13] + [(20, text), (21, text.replace("w9 ", "other ", 1)), (22, text.upper()), (23, text + " end"), (None, "alone here"), (24, "word " * 3000)]
    assert ordered(simhash.near_duplicates(documents(spark, rows)).collect()) == ordered(brute_near(rows))
    assert simhash.near_duplicates(documents(spark, rows).limit(0)).collect() == []


def test_simhash_of_documents(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    assert ordered(queries.QUERIES["op13_simhash"](spark, sf_dir).collect()) == ordered(brute_near(rows))


@pytest.mark.parametrize("longest", [2048, 64, 4])
def test_simhash_links_whatever_the_lists_length(spark, longest):
    """Clusters that differ in few bits fill lists of three and of five bytes; the shorter lists that replace them lose no link."""
    rng = random.Random(7)
    marks = [rng.getrandbits(64) for _ in range(60)]
    for centre in marks[:30]:
        for _ in range(20):
            marks.append(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}))
    for _ in range(600):
        marks.append(marks[0] ^ sum({1 << rng.choice([0, 1, 2, 9, 10, 17, 18, 33, 34, 60, 61]) for _ in range(rng.randrange(8))}))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    links = simhash.links(spark.createDataFrame([(signed(m),) for m in set(marks)], "fingerprint long"), longest)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    groups = {}
    for m, root in brute_components(marks).items():
        groups.setdefault(root, set()).add(roots.get(signed(m), signed(m)))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)
