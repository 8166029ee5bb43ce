"""Text functions: folding, tokens, overlap, hashes, language hints."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaero.values import patterns, words

SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = "\r\n|[\n\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
TOKEN = "[a-z0-9ёа-я]{3,}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def uni(pattern: str) -> str:
    """The pattern read without regard to case and with Unicode classes."""
    return "(?iU)" + pattern


def matches(c: Column | str, pattern: str) -> Column:
    return text_or_empty(c).rlike(uni(pattern))


def find_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(uni(pattern)), F.lit(group))


def string_array(values: Sequence[str]) -> Column:
    """A constant array; written as one split text to keep plans small."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def strip(c: Column | str) -> Column:
    """Trim every kind of white space from both ends."""
    return F.btrim(_col(c), F.lit(SPACES))


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?U)\s+", " ")


def lines(c: Column | str) -> Column:
    return F.split(text_or_empty(c), LINE_ENDS)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _any_of(texts: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(t) for t in texts) + ")"


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    return c.rlike(_any_of(needles))


def ends_with_any(c: Column, suffixes: Sequence[str]) -> Column:
    return c.rlike(_any_of(suffixes) + r"\z")


def like_any(c: Column, likes: Sequence[str]) -> Column:
    found = F.lit(False)
    for like in likes:
        found = found | c.ilike(like)
    return F.coalesce(found, F.lit(False))


LETTER_RANGES = [(0x80, 0x530), (0x1E00, 0x2000), (0x2070, 0x20A0), (0xFF01, 0xFF5F)]
FOLD_LONGER = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def _folding() -> tuple[str, str]:
    """Lower-case letters and their bare forms; marks without a partner are dropped.

    Read off the compatibility decomposition of each character in the Latin,
    Greek, Cyrillic, superscript and full-width ranges.
    """
    source, target, marks = [], [], []
    for point in (p for low, high in LETTER_RANGES for p in range(low, high)):
        char = chr(point)
        bare = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if char != char.lower() or bare == char:
            continue
        if not bare:
            marks.append(char)
        elif len(bare) == 1:
            source.append(char)
            target.append(bare)
    return "".join(source + marks), "".join(target)


FOLD_FROM, FOLD_TO = _folding()


def fold(c: Column | str) -> Column:
    """Lower case without accents; texts that are plain ASCII skip the letter map."""
    low = F.lower(text_or_empty(c))
    spelled = low
    for char, plain in FOLD_LONGER.items():
        spelled = F.replace(spelled, F.lit(char), F.lit(plain))
    has_longer = low.rlike("[" + "".join(FOLD_LONGER) + "]")
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(
        F.translate(F.when(has_longer, spelled).otherwise(low), FOLD_FROM, FOLD_TO)
    )


def folded_words(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Distinct topic tokens of a text."""
    return F.array_except(folded_words(fold(c)), string_array(words.STOP_WORDS))


def share_of(question_tokens: Column, text_tokens: Column) -> Column:
    """Share of the question's tokens that the text has; 0 when either has none."""
    n = F.size(question_tokens)
    return F.when(
        (n > 0) & (F.size(text_tokens) > 0),
        F.size(F.array_intersect(question_tokens, text_tokens)) / n,
    ).otherwise(F.lit(0.0))


def overlap(question: Column | str, text: Column | str) -> Column:
    return share_of(tokens(question), tokens(text))


def content_hash(c: Column | str) -> Column:
    return F.sha2(collapse_spaces(strip(c)), 256)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(r"(?U)\S+"))


def approx_tokens(c: Column | str) -> Column:
    """About three words make four tokens; never less than one."""
    return F.greatest(F.lit(1), F.floor(word_count(c) / F.lit(0.75)).cast("int"))


def majority_language(c: Column | str) -> Column:
    """``ru`` when Cyrillic characters outnumber the other letters, else ``ro``."""
    text = text_or_empty(c)
    cyrillic = F.regexp_count(text, F.lit("[\\u0400-\\u04FF]"))
    other = F.regexp_count(text, F.lit("[\\p{L}&&[^\\u0400-\\u04FF]]"))
    return F.when(cyrillic > other, F.lit("ru")).otherwise(F.lit("ro"))


def any_cyrillic(c: Column | str) -> Column:
    return text_or_empty(c).rlike("[\\u0400-\\u04FF]")


def question_language(c: Column | str) -> Column:
    """``struct(language, confidence)`` from script, hint words and diacritics."""
    return let(strip(text_or_empty(c)), _question_language)


def _question_language(q: Column) -> Column:
    found = F.transform(
        F.regexp_extract_all(q, F.lit("[A-Za-zăâîșțĂÂÎȘȚ]+"), F.lit(0)), F.lower
    )
    return let(found, lambda w: _language_of(q, w))


def _language_of(q: Column, found: Column) -> Column:
    n = F.size(found)
    english = F.size(F.filter(found, lambda w: w.isin(words.ENGLISH_HINTS)))
    romanian = F.size(F.filter(found, lambda w: w.isin(words.ROMANIAN_HINTS))) + F.when(
        q.rlike("[ăâîșțĂÂÎȘȚ]"), 2
    ).otherwise(0)
    total = F.greatest(n, F.lit(1))

    def answer(language: str, confidence: Column) -> Column:
        return F.struct(F.lit(language).alias("language"), confidence.cast("double").alias("confidence"))

    return (
        F.when(q == "", answer("ro", F.lit(0.0)))
        .when(any_cyrillic(q), answer("ru", F.lit(0.95)))
        .when(n == 0, answer("ro", F.lit(0.2)))
        .when(
            (english >= 2) & (english > romanian),
            answer("en", F.least(F.lit(0.95), 0.45 + english / total)),
        )
        .when(
            (romanian >= 1) & (romanian >= english),
            answer("ro", F.least(F.lit(0.95), 0.4 + romanian / total)),
        )
        .when((english == 1) & (romanian == 0) & (n <= 6), answer("en", F.lit(0.55)))
        .otherwise(answer("ro", F.lit(0.35)))
    )


def answer_language(question: Column | str, ui_language: Column | str | None = None) -> Column:
    """The language to answer in: the question's when clear, else the interface's."""
    return let(question_language(question), lambda seen: _answer_language(seen, ui_language))


def _answer_language(seen: Column, ui_language: Column | str | None) -> Column:
    hint = F.lit(None).cast("string")
    if ui_language is not None:
        trimmed = F.lower(strip(text_or_empty(ui_language)))
        hint = F.when(trimmed.isin("ro", "ru", "en"), trimmed)
    clear = seen["confidence"] >= 0.55
    return F.struct(
        F.when(clear, seen["language"]).otherwise(F.coalesce(hint, seen["language"])).alias("answer_language"),
        seen["language"].alias("question_language"),
        F.bround(seen["confidence"], 2).alias("question_confidence"),
        hint.alias("ui_language"),
        F.when(clear, F.lit("question"))
        .when(hint.isNotNull(), F.lit("ui_hint"))
        .otherwise(F.lit("question_weak"))
        .alias("source"),
    )


def latest_year_between(*parts: Column) -> Column:
    """The latest 20xx that stands between two other characters in the joined parts."""
    blob = F.concat_ws(" ", *[text_or_empty(p) for p in parts])
    found = F.regexp_extract_all(blob, F.lit(patterns.YEAR_BETWEEN), F.lit(1))
    return F.array_max(F.transform(found, lambda y: y.cast("int")))


def latest_year_alone(*parts: Column) -> Column:
    """The latest 20xx without digits next to it in the joined parts."""
    blob = F.concat_ws(" ", *[text_or_empty(p) for p in parts])
    return F.array_max(F.regexp_extract_all(blob, F.lit(patterns.YEAR_ALONE), F.lit(0)))
