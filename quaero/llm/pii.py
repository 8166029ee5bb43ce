"""Personal data: patterns propose spans, checksums confirm them, words beside them adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaero.functions.text import let
from quaero.llm.common import numbered

# So many characters before and after a match are searched for context words.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """``needs``: a text without this string or pattern has no match. ``base`` spans are kept whatever their score."""

    name: str
    pattern: str
    needs: str
    words: str
    base: bool


# The patterns start only where a run of their characters starts or the last match ended, and never give characters back:
# the matches are those of the plain patterns, in time linear in the text. No pattern looks beyond its match otherwise.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"\bip\b|address|host|server", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", "card|visa|master|credit|pay", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|tel|call|mobile|fax", True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[0-9]{1,3})?", "", "iban|account|bank|konto", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", r"\bssn\b|social security", False),
]
SURE, CHECKED, NAMED, ACCEPT = 0.5, 0.3, 0.2, 0.6


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return _sum(doubled) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN without spaces passes its check: the first four characters moved to the end, letters as 10 to 35."""
    moved = F.split(F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4)), "")
    value = lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c < "A", 10).otherwise(100) + value(c)) % 97
    return F.aggregate(moved, F.lit(0), step) == 1


def _passes(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.transform(F.split(match, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    short = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    return (
        F.when(kind == "ip", short)
        .when(kind == "card", F.length(digits).between(16, 19) & luhn(F.substring(digits, 1, 19)))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .when(kind == "iban", mod97(F.replace(match, F.lit(" "), F.lit(""))))
        .otherwise(True)
    )


def _beside(pieces: Column, i: Column) -> Column:
    """The CONTEXT characters before match ``i`` of ``pieces`` (m, gap, next) and those after it, other matches among them.

    A match has a character at least, so that CONTEXT neighbours reach as far; they are read only where a gap is shorter.
    """
    here = F.get(pieces, i)
    near = lambda first, n: F.slice(pieces, first, n)
    joined = lambda some, part: F.array_join(F.transform(some, part), "")
    first = F.greatest(i - CONTEXT, F.lit(0))
    back = joined(near(first + 1, i - first), lambda p: F.concat(F.right(p["gap"], F.lit(CONTEXT)), F.right(p["m"], F.lit(CONTEXT))))
    on = joined(near(i + 2, F.lit(CONTEXT)), lambda p: F.concat(F.left(p["m"], F.lit(CONTEXT)), F.left(p["next"], F.lit(CONTEXT))))
    full = lambda gap: F.length(gap) >= CONTEXT
    before = F.when(full(here["gap"]), here["gap"]).otherwise(F.concat(back, here["gap"]))
    after = F.when(full(here["next"]), here["next"]).otherwise(F.concat(here["next"], on))
    return F.concat_ws(" ", F.right(before, F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT)))


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """kind_no, i, gap (characters since the last match), match, beside: all matches of one pattern."""
    gaps = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("gap"), F.slice(gaps, 2, F.size(found)).alias("next"))
    each = let(pieces, lambda all_: F.transform(
        all_,
        lambda p, i: F.struct(
            F.lit(number).alias("kind_no"), i.alias("i"), F.length(p["gap"]).cast("long").alias("gap"), p["m"].alias("match"),
            _beside(all_, i).alias("beside"),
        ),
    ))
    none = F.array().cast("array<struct<kind_no:int,i:int,gap:bigint,match:string,beside:string>>")
    present = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    return F.when(present & text.rlike("[0-9@]") & text.rlike(kind.pattern), each).otherwise(none)


def spans(docs: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """row_id, doc_id, kind_no, kind, start, end, match, score, base: one row per span, and one without kind per document
    that has none.

    docs: doc_id, text; other columns are not read. Null and empty texts have no spans; a repeated row has its own. Positions
    are code points, ``end`` is exclusive. Base kinds stay if they pass their check; the others need a score of ACCEPT, which
    a checksum or a context word gives.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = numbered(docs.select("doc_id", "text")).select(
        "row_id", "doc_id", F.explode_outer(F.concat(*[_matches(text, k, kind) for k, kind in enumerate(kinds)])).alias("m")
    )
    names = F.array(*[F.lit(k.name) for k in kinds])
    flat = found.select("row_id", "doc_id", "m.*").repartition("row_id")
    so_far = F.sum(F.col("gap") + F.length("match")).over(W.partitionBy("row_id", "kind_no").orderBy("i"))
    placed = flat.withColumn("end", so_far).withColumn("kind", F.get(names, F.col("kind_no")))
    beside = F.lower("beside")
    named = F.lit(False)
    for kind in kinds:
        named = F.when(F.col("kind") == kind.name, beside.rlike(kind.words)).otherwise(named)
    checked = F.col("kind").isin("card", "iban", "ip")
    score = SURE + F.when(checked, CHECKED).otherwise(0.0) + F.when(named, NAMED).otherwise(0.0)
    base = F.col("kind").isin(*[k.name for k in kinds if k.base])
    judged = placed.withColumn("passes", F.col("kind").isNotNull() & _passes(F.col("kind"), F.col("match"))).withColumn(
        "score", F.when(F.col("passes"), score)
    )
    stays = F.col("passes") & (base | (F.col("score") >= ACCEPT))
    kept = lambda c: F.when(stays, c)
    return judged.select(
        "row_id", "doc_id", kept(F.col("kind_no")).alias("kind_no"), kept(F.col("kind")).alias("kind"),
        kept(F.col("end") - F.length("match")).alias("start"), kept(F.col("end")).alias("end"),
        kept(F.col("match")).alias("match"), F.col("score"), kept(base).alias("base"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans of each document."""
    found = spans(docs).withColumn(
        "span", F.when(F.col("kind").isNotNull(), F.struct("kind_no", "start", "end", "kind", "base"))
    )
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    in_order = F.array_sort("all")
    return (
        found.groupBy("row_id", "doc_id")
        .agg(*[count(k.name) for k in KINDS], F.collect_list("span").alias("all"))
        .select(
            "doc_id", "n_email", "n_ip", "n_card", "n_phone",
            F.sha2(listed(F.filter(in_order, lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
            listed(in_order).alias("spans"), "n_iban", "n_ssn",
        )
    )


def redact(docs: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """``docs`` with each confirmed span of ``text`` replaced by its kind in brackets; null stays null, other columns stay.

    Kinds are replaced one after the other, each in what the others left: mail addresses, cards, phones, then the rest.
    """
    order = ["email", "card", "phone", "ip", "iban", "ssn"]
    for kind in sorted(kinds, key=lambda k: order.index(k.name)):
        docs = docs.withColumn("text", _redacted(F.col("text"), kind))
    return docs


def _redacted(text: Column, kind: Kind) -> Column:
    def mask(match, beside):
        sure = _passes(F.lit(kind.name), match)
        if not kind.base and kind.name != "iban":
            sure &= F.lower(beside).rlike(kind.words)
        return F.when(sure, F.lit(f"[{kind.name.upper()}]")).otherwise(match)

    gaps = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.arrays_zip(found.alias("m"), gaps.alias("gap"), F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))).alias("next"))
    masked = let(pieces, lambda all_: F.transform(
        all_, lambda p, i: F.concat(p["gap"], F.when(p["m"].isNotNull(), mask(p["m"], _beside(all_, i))).otherwise(""))
    ))
    needs = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    return F.when(needs & text.rlike("[0-9@]") & text.rlike(kind.pattern), F.array_join(masked, "")).otherwise(text)
