"""Quality rules: text statistics, and a decision list learned from labelled ones by sequential covering.

Rules are grown, condition by condition, on part of the labelled rows and cut back on the rest; rows that a rule covers are
set aside before the next is grown. The list becomes one conditional expression of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.arrow import ROWS, give_back, map_batches, slices, texts_of
from quaero.llm.common import small
from quaero.llm.encoding import BLOCK, KINDS, SPACE, blocks, hashes

# At most so many labelled rows of each class are used to learn the rules, chosen by a hash of their number.
SAMPLE = 10_000
GRAM = 5
# Bytes of text that are parted at a time.
SPAN = 1 << 18
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_marks", "n_digits", "n_distinct"]
WHITE, SYMBOLS, MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"!?"
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _count(text: bytes, which: bytes) -> int:
    return len(text) - len(text.translate(None, which))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts in a row, and the number of words of each text."""
    joined = b"\n".join(texts)
    text = np.frombuffer(joined, dtype=np.uint8)
    inside = np.concatenate([[False], KINDS[text] != SPACE, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return hashes(text, starts, ends), np.diff(stops, prepend=0)


def grouped_word_hashes(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts in groups of SPAN bytes or so, longer ones alone: number of texts, their words' hashes, words of each."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= SPAN:
            size += len(texts[to])
            to += 1
        if size > BLOCK:
            words = np.concatenate([word_hashes([part])[0] for part in blocks(texts[at])])
            yield 1, words, np.array([len(words)])
        else:
            yield to - at, *word_hashes(texts[at:to])
        at = to


def repeated_words(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, its words in windows of GRAM words that it has more than once, and its distinct words."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = len(words)
    repeated = np.zeros(n + 1, dtype=np.int64)
    spread = _scramble(words)
    if n >= GRAM:
        last = n - GRAM + 1
        grams = owner[:last].astype(np.uint64) * _MIX[0]
        for k in range(GRAM):
            grams = _scramble(grams + spread[k : last + k] * _MIX[k])
        whole = np.flatnonzero(owner[:last] == owner[GRAM - 1 :])
        _, which, counts = np.unique(grams[whole], return_inverse=True, return_counts=True)
        again = whole[counts[which] > 1]
        np.add.at(repeated, again, 1)
        np.add.at(repeated, again + GRAM, -1)
    covered = np.cumsum(repeated)[:n] > 0
    _, first = np.unique(_scramble(spread + owner.astype(np.uint64) * _MIX[0]), return_index=True)
    most = len(sizes)
    return np.bincount(owner[covered], minlength=most), np.bincount(owner[first], minlength=most)


def _statistics(texts: list[bytes], chars: list[int], words: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    repeats, distinct = repeated_words(words, sizes)
    rows = []
    for text, n_chars in zip(texts, chars, strict=True):
        lines = [line for line in text.split(b"\n") if line.strip()]
        rows.append(
            (n_chars - _count(text, WHITE), _count(text, SYMBOLS), len(lines) - len(set(lines)), len(lines),
             _count(text, UPPER), _count(text, MARKS), _count(text, DIGITS))
        )
    word_chars, symbols, dups, lines, upper, marks, digits = np.array(rows, dtype=np.int64).reshape(-1, 7).T
    return [sizes, word_chars, symbols, dups, repeats, lines, upper, marks, digits, distinct]


def _measured(texts: list[bytes], chars: list[int]) -> list[np.ndarray]:
    """The counts of BASE and MORE of the texts, column by column."""
    parts, at = [], 0
    for n, words, sizes in grouped_word_hashes(texts):
        parts.append(_statistics(texts[at : at + n], chars[at : at + n], words, sizes))
        at += n
    if not parts:
        return [np.zeros(0, dtype=np.int64) for _ in BASE + MORE]
    return [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)]


def statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the counts of BASE and MORE for each row; a null text counts as empty. Words are what ASCII white space
    parts; lines without a word do not count."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            chars = [n or 0 for n in pc.utf8_length(batch.column("text")).to_pylist()]
            columns = [pa.array(c) for c in _measured(texts_of(batch), chars)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *columns], [*keys, *BASE, *MORE])

    kinds = [f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} bigint" for c in BASE + MORE]
    return map_batches(docs.select(*keys, "text"), measure, ", ".join(kinds))


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the counts as a structure ``name``; the other columns do not pass through Python."""

    @F.pandas_udf(", ".join(f"{c} bigint" for c in BASE + MORE))
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = []
            for at in range(0, len(texts), ROWS):
                plain = [t or "" for t in texts.iloc[at : at + ROWS]]
                counts = _measured([t.encode() for t in plain], [len(t) for t in plain])
                parts.append(pd.DataFrame(dict(zip(BASE + MORE, counts, strict=True))))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=BASE + MORE, dtype="int64")
        give_back()

    return docs.withColumn(name, measure("text"))


def features() -> dict[str, Column]:
    """The numbers that rules test, from the counts."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "word_length": ratio("word_chars", "n_words"),
        "symbols": ratio("n_symbols", "n_words"), "repeated_lines": ratio("n_dup_lines", "n_lines"),
        "repeated_words": ratio("n_repeat_words", "n_words"), "capitals": ratio("n_upper", "word_chars"),
        "marks": ratio("n_marks", "n_words"), "digits": ratio("n_digits", "word_chars"),
        "distinct": ratio("n_distinct", "n_words"), "line_words": ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold


Rule = list[Condition]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, dtype=bool)
    for condition in rule:
        held &= condition.holds(x)
    return held


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray, longest: int) -> Rule:
    """Adds the condition of the highest information gain until the rule covers no good row."""
    rule, held = [], np.ones(len(bad), dtype=bool)
    while len(rule) < longest:
        p, n = weight[held & bad].sum(), weight[held & ~bad].sum()
        if not n or not p:
            break
        best, gain = None, 1e-9
        for name, values in x.items():
            inside = values[held]
            cuts = np.unique(np.quantile(inside, np.linspace(0, 1, 65)))
            order = np.argsort(inside, kind="stable")
            ranked, w, b = inside[order], weight[held][order], bad[held][order]
            bad_below = np.concatenate([[0], np.cumsum(w * b)])
            good_below = np.concatenate([[0], np.cumsum(w * ~b)])
            at = np.searchsorted(ranked, cuts, side="left")
            for above in (True, False):
                ps = p - bad_below[at] if above else bad_below[at]
                ns = n - good_below[at] if above else good_below[at]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - np.log2(p / (p + n))), 0)
                k = int(np.argmax(gains))
                if gains[k] > gain:
                    best, gain = Condition(name, above, float(cuts[k])), gains[k]
        if best is None:
            break
        rule.append(best)
        held &= best.holds(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    held = _covers(rule, x, len(bad))
    p, n = weight[held & bad].sum(), weight[held & ~bad].sum()
    return (p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0


def learn_rules(
    x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray, precision: float = 0.9, longest: int = 4, most: int = 16
) -> list[Rule]:
    """The ordered rules that reject rows. A rule stays if at least ``precision`` of what it covers, among the rows kept for
    pruning, is bad; the first that does not ends the list."""
    turn = np.arange(len(bad)) % 3
    left, rules = np.ones(len(bad), dtype=bool), []
    while len(rules) < most:
        grow, prune = left & (turn > 0), left & (turn == 0)
        if not (grow & bad).any() or not (prune & bad).any():
            break
        pick = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows], weight[rows])  # noqa: E731, B023
        rule = _grow(*pick(grow), longest)
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (_worth(r, *pick(prune))[0], -len(r)))  # noqa: B023
        if _worth(rule, *pick(prune))[1] < precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Features, bad or not, and weights of at most ``sample`` labelled rows of each class that pass the base rules.

    A document with several labels counts as bad if one says so; rows without number or label are left out.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r.quality: r.n for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = marks.limit(0)
    for quality in sorted(totals):
        some = marks.filter(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = picked.unionByName(some)
    texts = docs.select("doc_id", "text").join(small(picked, sample * len(totals)), "doc_id")
    rows = statistics(texts, ["doc_id", "quality"]).filter(~base_failed())
    names = [c.alias(n) for n, c in features().items()]
    found = rows.select("doc_id", "quality", *names).orderBy(F.xxhash64("doc_id"), "doc_id", *features()).toPandas()
    weight = found["quality"].map({q: n / min(n, sample) for q, n in totals.items()})
    x = {name: found[name].to_numpy(dtype=float) for name in features()}
    return x, (found["quality"] == 0).to_numpy(dtype=bool), weight.to_numpy(dtype=float)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row, from 1, or null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    chain = None
    for number, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds &= condition.column()
        chain = F.when(holds, number) if chain is None else chain.when(holds, number)
    return chain


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    return learn_rules(*labelled(docs, labels, sample))


def assess(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rule (the number of the rejecting rule) of each row.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad). Null and empty texts have no words and fail; repeated rows
    are judged each for itself; without labels only the base rules reject; an empty table gives no rows. Other columns are
    not read.
    """
    rules = learned(docs, labels, sample)
    judged = statistics(docs, ["doc_id"]).withColumn("base_failed", base_failed())
    judged = judged.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).select("doc_id", *BASE, "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that neither the base rules nor the learned ones reject."""
    rules = learned(docs, labels, sample)
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"])
    counted = with_statistics(held, "counts").select("row", "counts.*")
    return counted.filter(~base_failed() & verdict(rules).isNull()).select("row.*")
