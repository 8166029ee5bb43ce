"""Toxicity: a weighted lexicon, learned from labelled rows, matched by Aho-Corasick on folded text.

Folding takes lookalike letters of other scripts and digits between letters back to plain letters, and leaves one blank
between words. Entries are whole words or beginnings of words; phrases in which an entry is harmless are exceptions. The
weights found are set against the text's length, and a logistic curve turns them into a score.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.arrow import map_batches, slices
from quaero.llm.common import small, stored

# At most so many labelled rows of each class are used to learn from, chosen by a hash of their number.
SAMPLE = 8_000
# At most so many candidate entries are counted in the sample, and the fewest toxic texts an entry must be in.
CANDIDATES, LEAST = 50_000, 4
# Beginnings of words of these lengths may be entries.
STEMS = (4, 5, 6, 7)

# Letters that look like Latin ones, digits that stand for letters, and harmless phrases.
LOOKALIKES = dict(zip("аеорсухіјѕԁһѵɡκορνιταεɑıⅼ", "aeopcyxijsdhvgkopvitaeail", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SIGNS = {"@": "a", "$": "s", "|": "l"}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "sore loser")

_BETWEEN = re.compile(r"(?<=[^\W\d_])[@$|0134578]+(?=[^\W\d_])|(?<![^\W_])[0134578](?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?![^\W_])")
_SIGNS = {ord(k): v for k, v in (DIGITS | SIGNS).items()}
_MARKS = {ord(k): v for k, v in LOOKALIKES.items()} | {c: " " for c in range(128) if not chr(c).isalnum()}
_DIGIT_OR_SIGN = re.compile(r"[@$|0-9]")


def fold(text: str) -> str:
    """Lower-case words with a blank before and after each; lookalikes and digits within words become letters."""
    text = unicodedata.normalize("NFKC", text.lower()) if not text.isascii() else text.lower()
    if _DIGIT_OR_SIGN.search(text):
        text = _BETWEEN.sub(lambda m: m.group().translate(_SIGNS), text)
    return " " + " ".join(text.translate(_MARKS).split()) + " "


@dataclass
class Lexicon:
    """``weights``: " word " or " beginning" to log odds; ``exceptions``: phrases whose words do not count; the score is
    the logistic of ``bias`` + ``slope`` x weight found per square root of the words + ``found`` x log(1 + weight found)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    bias: float = -4.0
    slope: float = 0.0
    found: float = 0.0


class Matcher:
    """The lexicon as one automaton."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float]:
        """Weight per square root of the number of words, and log(1 + weight), of folded text."""
        total, hits, spared = 0.0, [], []
        if len(self.automaton):
            for end, (size, weight) in self.automaton.iter(text):
                if weight is None:
                    spared.append((end - size + 1, end))
                else:
                    hits.append((end - size + 1, end, weight))
        if spared:
            # Both lists come by their ends: of the exceptions that end no sooner than a hit, the first start is what counts.
            ends = [b for _, b in spared]
            first = list(accumulate((a for a, _ in reversed(spared)), min))[::-1]
            behind = [bisect_left(ends, end) for _, end, _ in hits]
            hits = [h for h, k in zip(hits, behind) if k == len(ends) or h[0] < first[k]]
        best: dict[int, float] = {}
        for start, _, weight in hits:  # of the entries that begin at one word, the heaviest counts
            best[start] = max(weight, best.get(start, 0.0))
        total = sum(best.values())
        return total / math.sqrt(max(1, text.count(" ") - 1)), math.log1p(total)

    def score(self, text: str) -> float:
        density, found = self.features(fold(text))
        one = self.lexicon
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, one.bias + one.slope * density + one.found * found))))


def held_out() -> Column:
    """Whether a row is kept out of learning: crc32 of the number as text, divisible by 5. No number counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [fold(t or "") for t in batch.column("text").to_pylist()]


def _entries(text: str) -> set[str]:
    words = set(text.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


def _toxic_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in slices(batches):
        for text in _texts(batch):
            counts.update(_entries(text))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, float]]:
    """text, toxic of at most ``sample`` labelled rows of each class outside the held-out part, and how many each stands for."""
    marks = labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = marks.limit(0)
    for toxic in sorted(totals):
        picked = picked.unionByName(marks.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(small(picked, 2 * sample), "doc_id").select("text", "toxic")
    return rows, {k: n / min(n, sample) for k, n in totals.items()}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon of the labelled rows; without toxic and other rows it is empty, and every score low."""
    rows, stands_for = training_rows(docs, labels, sample)
    if len(stands_for) < 2:
        return Lexicon(exceptions=exceptions)
    rows = stored(rows, "training")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon(exceptions=exceptions)
    toxic = map_batches(rows.filter("toxic = 1").select("text"), _toxic_entries, "entry string, n bigint")
    found = toxic.groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "entry").limit(CANDIDATES)
    candidates = {r.entry: r.n for r in found.collect()}
    clean = _clean_counts(rows, candidates)
    weights = choose(candidates, clean, n[1], n[0])
    lexicon = Lexicon(weights, (*exceptions, *_harmless(rows, weights)))
    return _calibrated(rows, lexicon, stands_for)


def _clean_counts(rows: DataFrame, candidates: dict[str, int]) -> dict[str, int]:
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in _texts(batch):
                counts.update(_entries(text) & shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])

    counted = map_batches(rows.filter("toxic = 0").select("text"), count, "entry string, n bigint")
    return {r.entry: r.n for r in counted.groupBy("entry").agg(F.sum("n").alias("n")).collect()}


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: float = 2.0) -> dict[str, float]:
    """Entries whose log odds of being in a toxic text are at least ``least``. Of nested ones the longest stays that is in
    nine tenths of the toxic texts of the shortest, and those that weigh clearly more than what they begin with."""
    weight = {e: math.log((t + 0.5) / (n_toxic + 1) / ((clean.get(e, 0) + 0.5) / (n_clean + 1))) for e, t in toxic.items()}
    kept: dict[str, float] = {}
    stands_for: dict[str, str] = {}
    for entry in sorted((e for e, w in weight.items() if w >= least), key=lambda e: (len(e.strip()), e)):
        begins = next((stands_for[entry[:k]] for k in range(len(entry) - 1, STEMS[0], -1) if entry[:k] in stands_for), None)
        if begins in kept and toxic[entry] >= 0.9 * toxic[begins]:
            del kept[begins]
            stands_for |= {e: entry for e, of in stands_for.items() if of == begins}
        elif begins is not None and weight[entry] < weight[begins] + 1:
            continue
        kept[entry], stands_for[entry] = weight[entry], entry
    return kept


def _harmless(rows: DataFrame, weights: dict[str, float]) -> list[str]:
    """Pairs of words with an entry that at least three clean texts have and no toxic one."""
    matcher = rows.sparkSession.sparkContext.broadcast(weights)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Matcher(Lexicon(matcher.value)).automaton
        counts: Counter = Counter()
        for batch in slices(batches):
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist(), strict=True):
                seen = set()
                for end, (size, _) in find.iter(text) if len(find) else ():
                    start = end - size + 1
                    word = text.index(" ", start + 1)
                    after = text.find(" ", word + 1)
                    before = text.rfind(" ", 0, start) if start else -1
                    if after > 0:
                        seen.add(text[start + 1 : after])
                    if before >= 0:
                        seen.add(text[before + 1 : word])
                counts.update((p, toxic) for p in seen)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
            ["pair", "toxic", "n"],
        )

    counted = map_batches(rows, pairs, "pair string, toxic int, n bigint").groupBy("pair").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
    )
    found = counted.filter("clean >= 3 and bad = 0").orderBy(F.desc("clean"), "pair").limit(1000).collect()
    return [r.pair for r in found]


def _calibrated(rows: DataFrame, lexicon: Lexicon, stands_for: dict[int, float]) -> Lexicon:
    """The lexicon with the logistic curve of its two features over the training rows."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in slices(batches):
            x = np.array([matcher.features(t) for t in _texts(batch)], dtype=float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("toxic")], ["density", "found", "toxic"])

    measured = map_batches(rows, measure, "density double, found double, toxic int").collect()
    x = np.array([(1.0, r.density, r.found) for r in measured])
    y = np.array([float(r.toxic) for r in measured])
    w = np.array([stands_for[r.toxic] for r in measured])
    beta = np.zeros(3)
    for _ in range(50):  # Newton's steps, held back by a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - 0.5 * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    lexicon.bias, lexicon.slope, lexicon.found = map(float, beta)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text), from the text alone.

    Null and empty texts are scored as texts without a match; repeated rows alike; extra columns are not read; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    key = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in slices(batches):
            scores = np.array([matcher.score(t or "") for t in batch.column("text").to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), judge, f"doc_id {key}, held_out boolean, score double, predicted int"
    )


@functools.lru_cache(maxsize=1)
def _matcher(shared) -> Matcher:
    """One automaton for each Python worker and lexicon."""
    return Matcher(shared.value)


def assess(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from the labelled rows that are not held out and scores every row."""
    return score(docs, learn(docs, labels, sample))
