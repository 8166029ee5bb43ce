"""Periodic runs of words by Baier's grouping.

The first phase of Baier's suffix sorter puts suffixes into groups whose members begin with the same longest Lyndon word, so
the lengths of those words (the Lyndon array) come straight from the groups. It is done under an order of the words and under
its inverse: every run has its Lyndon roots among the longest Lyndon words of one of the two, one after another. Three equal
neighbouring words of a group seed a run, and its ends are found by the longest common extensions of the text with itself one
period on.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.arrow import slices, texts_of

WORD = r"[^\x20\x09-\x0D]+"
# A run is at least so many words long, and so many times its period.
LEAST, TIMES = 6, 4
# All windows of so many words inside a run occur twice or more, which holds for LEAST and TIMES as they are.
WINDOW = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_groups(word: list[int], inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of the longest Lyndon word that starts there, and its group: equal for equal words.

    Groups are gone through from the largest down. A suffix of the group at hand ends the Lyndon word of the nearest suffix
    before it that lies in a smaller group; suffixes with k such followers get the group's word k times, in a new group right
    above their old one. Positions whose group is done are skipped by path halving, so the time is all but linear.
    """
    first: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(word, 1):
        first[x].append(i)
    members = [first[x] for x in sorted(first, reverse=inverse)]
    group = [0] * (len(word) + 1)
    for g, positions in enumerate(members):
        for i in positions:
            group[i] = g
    length = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    above[-1:] = [-1] * bool(members)
    up = list(range(len(word) + 1))
    g = len(members) - 1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        for i in here:
            up[i] = i - 1
        followers: dict[int, int] = defaultdict(int)
        for i in here:
            j = up[i]
            while up[j] != j:
                up[j] = j = up[up[j]]
            up[i] = j
            if j:
                followers[j] += 1
        moved: dict[tuple[int, int], list[int]] = defaultdict(list)
        for j, k in followers.items():
            moved[k, group[j]].append(j)
        for k, old in sorted(moved, reverse=True):
            positions = moved[k, old]
            new = len(members)
            members.append(positions)
            length.append(length[old] + k * length[g])
            below.append(old)
            above.append(above[old])
            below[above[old]] = above[old] = new
            for j in positions:
                group[j] = new
        g = below[g]
    groups = np.array(group[1:], dtype=np.int64)
    return np.array(length, dtype=np.int64)[groups], groups


def _extended(word: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The ends of the longest stretch around ``start`` to ``end`` that keeps ``period``."""
    step = period
    while end < len(word):
        unlike = word[end : end + step] != word[end - period : end - period + step][: len(word) - end]
        at = int(unlike.argmax())
        if unlike[at]:
            end += at
            break
        end += len(unlike)
        step *= 2
    step = period
    while start > 0:
        low = max(0, start - step)
        unlike = (word[low:start] != word[low + period : start + period])[::-1]
        at = int(unlike.argmax())
        if unlike[at]:
            start -= at
            break
        start = low
        step *= 2
    return start, end


def runs_of(word: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of the runs of ``word`` (numbers that tell words apart), by start and period."""
    found = set()
    for inverse in (False, True):
        length, group = lyndon_groups(word.tolist(), inverse)
        at = np.flatnonzero(np.arange(len(word)) + 3 * length <= len(word))
        one, two = at + length[at], at + 2 * length[at]
        seeds = at[(group[one] == group[at]) & (group[two] == group[at])]
        before = seeds - length[seeds]
        heads = seeds[(before < 0) | (group[before] != group[seeds])]
        for start in heads.tolist():
            period, same = int(length[start]), group[start]
            end = start + 3 * period
            while end + period <= len(word) and group[end] == same:
                end += period
            low, high = _extended(word, start, end, period)
            if high - low >= max(LEAST, TIMES * period):
                found.add((low, high - low, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(word: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches of ``word`` outside which no run lies: all windows of WINDOW words in them occur more than once.

    Windows are told apart by hashes; windows that collide only make a stretch longer.
    """
    if len(word) < LEAST:
        return
    last = len(word) - WINDOW + 1
    mixed = np.zeros(last, dtype=np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _STEP + word[k : last + k].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    twice = np.zeros(last, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]])))
    for low, high in edges.reshape(-1, 2).tolist():
        if high + WINDOW - 1 - low >= LEAST:
            yield low, high + WINDOW - 1


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of ``words``, by start and period."""
    seen: dict[bytes, int] = {}
    word = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    return [(low + start, length, period) for low, high in stretches(word) for start, length, period in runs_of(word[low:high])]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space: of each run the first period stays."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start and then period), collapsed of each row of ``docs``
    (doc_id, text).

    Words are what whitespace of ASCII parts; a run is a stretch with smallest period q of at least max(LEAST, TIMES x q)
    words that no neighbouring word extends, and ``collapsed`` is the text without what its runs repeat, words joined by one
    space. A null text is empty and has no runs; rows without number and repeated rows give a row each, an empty table none.
    Texts are read whole, each by itself, so nothing is shuffled. Other columns are not read.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, runs, texts = [], [], []
            for text in texts_of(batch):
                words = text.split()
                found = find_runs(words)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapse(words, found))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(build, f"doc_id {key}, n_words bigint, runs {kind}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text of ``docs``, where a tenth of the texts goes on periodically from some word on: with h the crc32 of the
    number as text and g = h / 10, those with h % 10 = 0 repeat the p words from word a = g % n to the end of their n words,
    p = 1 + (n - a) / (3 + g % 8). Rows without number or words stay as they are."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    picked = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0) & F.col("text").rlike(WORD)
    chosen = docs.select("doc_id", "text", F.when(picked, words).alias("_words"))
    g, n = F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10"), F.size("_words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeats = F.flatten(F.array_repeat(F.slice("_words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    again = F.slice(F.concat(F.slice("_words", F.lit(1), a), repeats), F.lit(1), n)
    return chosen.select("doc_id", F.when(F.col("_words").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def _longest(runs: Column) -> Column:
    """The run with the greatest length / period, the first of such; null without runs."""
    better = lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)
    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def digest(docs: DataFrame) -> DataFrame:
    """The runs of ``docs`` in the form of the registered query: the run of greatest exponent, and digests of all runs and of
    the text without repetitions."""
    found = periodic_runs(docs).withColumn("best", _longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
