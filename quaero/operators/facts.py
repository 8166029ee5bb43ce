"""Facts read from evidence: contacts, dates, deadlines, vacancies, numeric claims."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaero.functions import text as T
from quaero.operators.keyed import first_rows, sent
from quaero.session import cut_lineage
from quaero.values import patterns, words

MONTH_NAMES = "|".join(words.MONTHS)
# Fixed value: the three shapes of a date in an announcement.
DATE_SHAPE = (
    r"(?<!\d)(?:20\d{2})-(?:\d{1,2})-(?:\d{1,2})(?!\d)|"
    r"(?<!\d)(?:\d{1,2})[./-](?:\d{1,2})[./-](?:20\d{2})(?!\d)|"
    r"(?<!\d)(?:\d{1,2})\s*(?:de\s*)?(?:" + MONTH_NAMES + r")\s*(?:anul\s*)?(?:20\d{2})(?!\d)"
)
CUE_WINDOW = 120
# Parts that the documents of one question are laid out in, and hits from which on a question is.
PARTS = 64
CROWDED = 50_000


# --- contacts and mentions -------------------------------------------------------------

def _distinct_first(found: Column, n: int) -> Column:
    return F.slice(F.array_distinct(found), 1, n)


def phones(c: Column | str) -> Column:
    return _distinct_first(F.regexp_extract_all(T.text_or_empty(c), F.lit(patterns.PHONE), F.lit(0)), 5)


def emails(c: Column | str, known: Column | None = None) -> Column:
    """Addresses in lower case; the institution's own one, if among them, comes first."""
    found = F.regexp_extract_all(T.text_or_empty(c), F.lit(patterns.EMAIL), F.lit(0))
    all_found = _distinct_first(F.transform(found, F.lower), 5)
    if known is None:
        return all_found
    wanted = F.coalesce(F.lower(known), F.lit(""))
    return T.let(
        all_found,
        lambda listed: F.when(
            F.array_contains(listed, wanted), F.concat(F.array(wanted), F.array_remove(listed, wanted))
        ).otherwise(listed),
    )


def addresses(c: Column | str) -> Column:
    return _distinct_first(F.transform(T.find_all(c, patterns.ADDRESS), T.strip), 3)


def date_mentions(c: Column | str) -> Column:
    return T.find_all(c, patterns.DATE_MENTION, 1)


def duration_mentions(c: Column | str) -> Column:
    return T.find_all(c, patterns.DURATION_MENTION, 1)


def _joined_hits(hits: DataFrame, top: int) -> DataFrame:
    """One text per question from its first hits; at most ``top`` of them."""
    few = first_rows(hits, ["query_id"], [F.asc("pos"), F.asc("chunk_id")], top)
    blob = F.concat(T.text_or_empty("document_title"), F.lit("\n"), T.text_or_empty("content"))
    return few.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "chunk_id", blob.alias("text")))).alias("_parts")
    )


def contact_fields(hits: DataFrame, known_email: DataFrame | None = None, top: int = 8) -> DataFrame:
    """Phones, emails and addresses per question. ``known_email`` has (query_id, email)."""
    joined = _joined_hits(hits, top).withColumn(
        "_text", F.array_join(F.transform("_parts", lambda p: p["text"]), "\n")
    )
    if known_email is None:
        joined = joined.withColumn("email", F.lit(None).cast("string"))
    else:
        joined = joined.join(known_email.select("query_id", "email"), "query_id", "left")
    return joined.select(
        "query_id", phones("_text").alias("phones"),
        emails("_text", F.col("email")).alias("emails"), addresses("_text").alias("addresses"),
    )


def dates_and_durations(hits: DataFrame, top: int = 6) -> DataFrame:
    joined = _joined_hits(hits, top)
    return joined.select(
        "query_id",
        _distinct_first(F.flatten(F.transform("_parts", lambda p: date_mentions(p["text"]))), 12).alias("dates"),
        _distinct_first(F.flatten(F.transform("_parts", lambda p: duration_mentions(p["text"]))), 8).alias("deadlines"),
    )


# --- vacancies -------------------------------------------------------------------------

def _read_date(found: Column) -> Column:
    numbers = F.regexp_extract_all(found, F.lit(r"\d+"), F.lit(0))
    month_name = F.regexp_extract(F.lower(found), MONTH_NAMES, 0)
    month_of = F.create_map(*[F.lit(x) for pair in words.MONTHS.items() for x in pair])
    parts = (
        F.when(month_name != "", F.array(F.get(numbers, F.lit(1)),
                                         F.try_element_at(month_of, month_name).cast("string"),
                                         F.get(numbers, F.lit(0))))
        .when(found.rlike("^20\\d{2}-"), numbers)
        .otherwise(F.reverse(numbers))
    )
    return F.try_to_date(F.array_join(parts, "-"), "y-M-d")


def application_deadlines(c: Column | str) -> Column:
    """Sorted distinct dates that follow a deadline cue on its line within 120 characters."""
    cue = patterns.APPLICATION_CUE + r"(?=([^\n]{0,%d}))" % CUE_WINDOW
    windows = F.regexp_extract_all(T.fold(c), F.lit(T.uni(cue)), F.lit(1))
    found = F.flatten(F.transform(windows, lambda w: F.regexp_extract_all(w, F.lit(T.uni(DATE_SHAPE)), F.lit(0))))
    dates = F.transform(found, _read_date)
    return F.array_sort(F.array_distinct(F.filter(dates, lambda d: d.isNotNull())))


def vacancy_state(title: Column, content: Column, today: datetime.date) -> Column:
    """``open`` needs one single deadline after today; a past one is ``expired``."""
    day = F.lit(today)

    def state(dates: Column) -> Column:
        latest = F.array_max(dates)
        return (
            F.when(F.size(dates) == 0, "unverified")
            .when(latest < day, "expired")
            .when((latest == day) | (F.size(dates) > 1), "unverified")
            .otherwise("open")
        )

    return T.let(
        application_deadlines(F.concat(T.text_or_empty(title), F.lit("\n"), T.text_or_empty(content))), state
    )


def sector_in_question(q: Column | str) -> Column:
    """The sector a question names, if it names exactly one."""
    found = F.regexp_extract_all(T.fold(q), F.lit("[a-z]+"), F.lit(0))
    named = F.array_intersect(T.string_array(words.SECTORS), found)
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def _sectors_within(folded: Column) -> Column:
    return T.let(folded, lambda f: F.filter(T.string_array(words.SECTORS), lambda s: F.contains(f, s)))


def matches_sector(title: Column, url: Column, content: Column, sector: Column) -> Column:
    """Does a hit belong to the sector: by title and URL, else by its body's office line."""
    alone = lambda found: (F.size(found) == 1) & (F.get(found, F.lit(0)) == sector)

    def by_body(body: Column) -> Column:
        office = F.regexp_extract_all(
            body, F.lit("(?U)pretur\\w*\\s+(?:sectorului\\s+)?(" + "|".join(words.SECTORS) + ")\\b"), F.lit(1)
        )
        return alone(_sectors_within(body)) & F.array_contains(office, F.coalesce(sector, F.lit("")))

    def by_heading(heading: Column) -> Column:
        return F.when(F.size(heading) > 0, alone(heading)).otherwise(T.let(T.fold(content), by_body))

    named = _sectors_within(T.fold(F.concat_ws(" ", T.text_or_empty(title), T.text_or_empty(url))))
    return F.when(sector.isNull(), F.lit(True)).otherwise(T.let(named, by_heading))


def vacancy_excerpt(c: Column | str, limit: int = 2200) -> Column:
    """Header and deadline of a long announcement within ``limit`` characters."""
    return T.let(T.text_or_empty(c), lambda text: F.when(F.length(text) <= limit, text).otherwise(
        T.let(T.fold(text), lambda folded: _long_excerpt(text, folded, limit))))


def _long_excerpt(text: Column, folded: Column, limit: int) -> Column:
    cue = patterns.APPLICATION_CUE
    pieces = F.split(folded, T.uni(cue), -1)
    found = F.regexp_extract_all(folded, F.lit(T.uni(cue)), F.lit(0))
    after = F.transform(
        spans(pieces, found),
        lambda s: F.struct(
            s["start"].alias("start"),
            F.substring(folded, s["end"] + 1, F.lit(CUE_WINDOW)).rlike(T.uni(DATE_SHAPE)).alias("dated"),
        ),
    )
    first = F.get(F.filter(after, lambda s: s["dated"]), F.lit(0))["start"]
    begin = F.greatest(F.lit(0), first - 250)
    head = F.substring(text, 1, 500)
    tail = F.substring(text, begin + 1, limit - F.length(head) - 3)
    return F.when(first.isNull() | (first < limit - 150), F.substring(text, 1, limit)).otherwise(
        F.concat(head, F.lit("\n…\n"), tail)
    )


# --- numeric claims --------------------------------------------------------------------

def spans(pieces: Column, found: Column) -> Column:
    """0-based ``struct(start, end)`` of each match, from the text around the matches."""
    lengths = F.zip_with(
        F.slice(pieces, 1, F.size(found)), found,
        lambda piece, match: F.struct(F.length(piece).alias("gap"), F.length(match).alias("size")),
    )
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        begin = (acc["at"] + x["gap"]).cast("int")
        end = (begin + x["size"]).cast("int")
        return F.struct(
            end.alias("at"),
            F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"),
        )

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def claim_field(q: Column | str) -> Column:
    """What a question asks to be compared; vacancies legitimately differ, so never theirs."""
    return F.when(
        ~T.matches(q, patterns.JOB_WORDS),
        F.when(T.matches(q, patterns.FEE_QUESTION), "fee")
        .when(T.matches(q, patterns.DURATION_QUESTION), "duration_days"),
    )


def subject_roots(q: Column | str) -> Column:
    roots = F.array_distinct(F.transform(T.tokens(q), lambda w: F.substring(w, 1, 5)))
    return F.filter(
        F.array_except(roots, T.string_array(words.FIELD_ROOTS)), lambda r: F.length(r) >= 4
    )


def _plain_amount(field: Column, amount: Column) -> Column:
    dotted = F.replace(amount, F.lit(","), F.lit("."))
    shortened = F.regexp_replace(
        F.regexp_replace(dotted.cast("double").cast("string"), "0+$", ""), "\\.$", ""
    )
    return F.when((field == "fee") & dotted.contains("."), shortened).otherwise(dotted)


def claims(title: Column, content: Column, field: Column, roots: Column) -> Column:
    """``array<struct(amount, quote, qualifier)>``: amounts near a cue that speak of the subject."""
    text = T.text_or_empty(content)

    def of(pattern: str, cue: str, days: bool) -> Column:
        amounts = F.regexp_extract_all(text, F.lit(T.uni(pattern)), F.lit(1))
        where = spans(
            F.split(text, T.uni(pattern), -1), F.regexp_extract_all(text, F.lit(T.uni(pattern)), F.lit(0))
        )

        def around(span: Column, amount: Column) -> Column:
            begin = F.greatest(F.lit(0), span["start"] - 100)
            window = F.substring(text, begin + 1, span["end"] + 65 - begin)
            return F.struct(amount.alias("amount"), span["end"].alias("end"), window.alias("window"))

        def named(found: Column) -> Column:
            near = F.concat_ws(" ", T.text_or_empty(title), found["window"])
            return F.struct(found["amount"].alias("amount"), found["end"].alias("end"), found["window"].alias("window"), near.alias("near"))

        def spoken_of(found: Column) -> Column:
            held = lambda folded: F.size(F.filter(roots, lambda r: F.contains(folded, r)))
            return T.let(T.fold(found["near"]), held) >= F.least(F.lit(2), F.size(roots))

        def read(found: Column) -> Column:
            qualifiers = F.array_sort(F.transform(T.find_all(found["near"], patterns.CLAIM_QUALIFIER), lambda m: T.fold(m)))
            if days:
                tail = T.fold(F.substring(text, found["end"] + 1, F.lit(25)))
                kind = T.let(tail, lambda said: F.when(said.rlike(patterns.WORKING_DAYS_TAIL), F.array(F.lit("working_days"))).when(
                    said.rlike(patterns.CALENDAR_DAYS_TAIL), F.array(F.lit("calendar_days"))
                ))
                qualifiers = F.concat(qualifiers, F.coalesce(kind, T.string_array([])))
            return F.struct(
                _plain_amount(field, found["amount"]).alias("amount"),
                F.substring(T.strip(found["window"]), 1, 280).alias("quote"), F.array_join(qualifiers, ",").alias("qualifier"),
            )

        # The cheap test first: most amounts have no cue next to them.
        cued = F.filter(F.zip_with(where, amounts, around), lambda found: T.matches(found["window"], cue))
        return F.transform(F.filter(F.transform(cued, named), spoken_of), read)

    return F.when(field == "fee", of(patterns.MONEY_AMOUNT, patterns.FEE_CUE, False)).when(
        field == "duration_days", of(patterns.DAYS_AMOUNT, patterns.DURATION_CUE, True)
    )


def _hit_claim(found: Column) -> Column:
    """The first claim of a hit, and whether it states different ones."""
    values = F.transform(found, lambda c: F.struct(c["amount"], c["qualifier"]))
    return F.struct(F.coalesce(F.size(F.array_distinct(values)) > 1, F.lit(False)).alias("mixed"), F.get(found, F.lit(0)).alias("claim"))


def _document_claims(hits: DataFrame, spread: bool) -> DataFrame:
    """``clear_claims``, laid out by question or, ``spread``, by question and ``_part`` of its documents.

    Hits are laid out once, a column for each value so that what nobody asks
    for stays behind; hits without one claim are sent without their texts. What
    a question asks for is worked out once, however many hits it has.
    """
    questions = hits.select("question").distinct().withColumn("field", claim_field("question")).filter("field is not null")
    questions = cut_lineage(questions.withColumn("_roots", subject_roots("question")).filter(F.size("_roots") >= 2))
    # Hits of other questions have a say in a document's place alone.
    asked = hits.filter("query_id is not null and document_id is not null").join(sent(questions), "question", "left")
    read = claims(F.col("document_title"), F.col("content"), F.col("field"), F.col("_roots"))
    told = asked.withColumn("_said", T.let(read, _hit_claim))
    claim = F.col("_said.claim")
    alone = lambda c: F.when(~F.col("_said.mixed") & claim.isNotNull(), c)
    part = F.pmod(F.xxhash64("document_id"), F.lit(PARTS)).cast("int").alias("_part")
    place = ["query_id", *(["_part"] if spread else [])]
    rows = told.select(
        "query_id", *([part] if spread else []), "document_id", "pos", F.when(claim.isNotNull(), F.col("field")).alias("field"),
        # An amount is of digits, points and commas. A field without a value stands for different ones.
        alone(F.concat(claim["amount"], F.lit("|"), claim["qualifier"])).alias("value"), alone(claim["quote"]).alias("quote"),
        *[alone(F.col(c)).alias(c) for c in ("chunk_id", "document_title", "document_url", "page")],
        alone(T.latest_year_alone("document_title", "document_url")).alias("year"),
    ).repartition(*place)
    document = [*place, "document_id"]
    first = F.when(F.col("value").isNotNull(), F.struct("pos", "chunk_id"))
    per_field = rows.groupBy(*document, "field").agg(
        F.min("pos").alias("_pos"), F.min("value").alias("_low"), F.max("value").alias("_high"), F.bool_or(F.isnull("value")).alias("_mixed"),
        *[F.min_by(c, first).alias(c) for c in ("quote", "document_title", "document_url", "page", "year")],
    )
    placed = per_field.withColumn("pos", F.min("_pos").over(Window.partitionBy(*document)))
    return placed.filter("field is not null and not _mixed and _low = _high").select(
        *document, "field", "pos", F.substring_index("_low", "|", 1).alias("amount"),
        F.expr("substring(_low, locate('|', _low) + 1)").alias("qualifier"),
        "quote", "document_title", "document_url", "page", "year",
    )


def clear_claims(hits: DataFrame) -> DataFrame:
    """One claim per (question, document): documents with two different ones are left out."""
    return _document_claims(hits, spread=True).drop("_part")


def _first_of_each_kind(told: DataFrame, kind: list[str], limit: int) -> DataFrame:
    """What the first ``limit`` pairs of a kind can be made of.

    Documents alike in value, year and URL can replace one another, so only the
    first of each can be part of the first pairs; the bounds follow from counting
    how many later documents a rightful pair can still skip, and lose nothing.
    The documents counted stand in the same group, so a part of a kind can be
    bounded by itself before the whole.
    """
    place = [F.asc("pos"), F.asc("document_id")]
    alike = 2 * limit - 1
    few = first_rows(told, [*kind, "year", "amount", "document_url"], place, alike)
    same_value = 2 * (limit - 1) + 2 * alike + 2
    few = first_rows(few, [*kind, "year", "amount"], place, same_value)
    # A document without an address shares it with none. Rows take one way only, so that claims are not read once for each.
    own = F.when(F.coalesce("document_url", F.lit("")) == "", F.col("document_id"))
    few = first_rows(few.withColumn("_own", own), [*kind, "year", "document_url", "_own"], place, same_value)
    return first_rows(few, [*kind, "year"], place, 2 * (limit - 1) + 2 * same_value + 2).drop("_own")


def _first_pairs(documents: Column, limit: int) -> Column:
    """The first pairs ``(l, r)`` that differ, of documents in their order; no more are looked for once there are ``limit``."""

    def differ(left: Column, right: Column) -> Column:
        later = (left["pos"] < right["pos"]) | ((left["pos"] == right["pos"]) & (left["document_id"] < right["document_id"]))
        same_address = (F.coalesce(left["url"], F.lit("")) != "") & left["url"].eqNullSafe(right["url"])
        other_years = F.coalesce(left["year"] != right["year"], F.lit(False))
        return later & (left["amount"] != right["amount"]) & ~same_address & ~other_years

    pair = lambda left, right: F.struct(left.alias("l"), right.alias("r"))
    more = lambda found, left: F.concat(found, F.transform(F.filter(documents, lambda right: differ(left, right)), lambda right: pair(left, right)))
    none = F.transform(F.slice(documents, 1, 0), lambda d: pair(d, d))
    return F.slice(F.aggregate(documents, none, lambda found, left: F.when(F.size(found) >= limit, found).otherwise(more(found, left))), 1, limit)


def conflicts(hits: DataFrame, limit: int = 3) -> DataFrame:
    """The first ``limit`` pairs of documents per question that state different values.

    ``hits`` has (query_id, question, pos, chunk_id, document_id,
    document_title, document_url, content, page). Pairs are never formed over a
    whole group. Hits go over the network once, by question; where a question
    has more than ``CROWDED`` (counted before), they go by parts of its
    documents, and what is left of each part by kind.
    """
    kind = ["query_id", "field", "qualifier"]
    crowded = not hits.groupBy("query_id").count().filter((F.col("count") > CROWDED) & F.col("query_id").isNotNull()).isEmpty()
    few = _document_claims(hits, spread=crowded)
    if crowded:
        few = _first_of_each_kind(few, ["_part", *kind], limit).drop("_part").repartition(*kind)
    few = _first_of_each_kind(few, kind, limit)
    # Texts have a list of their own, which goes where nobody asks for them.
    listed = few.groupBy(*kind).agg(
        F.sort_array(F.collect_list(F.struct("pos", "document_id", "amount", F.col("document_url").alias("url"), "year"))).alias("_documents"),
        F.collect_list(F.struct("document_id", "document_title", "quote", "page")).alias("_texts"),
    )
    pairs = listed.withColumn("_pair", F.explode(_first_pairs(F.col("_documents"), limit)))
    text = lambda s: F.get(F.filter("_texts", lambda t: t["document_id"] == F.col(f"_pair.{s}.document_id")), F.lit(0))
    pairs = pairs.select("query_id", "field", F.col("_pair.l").alias("l"), F.col("_pair.r").alias("r"), text("l").alias("l_text"), text("r").alias("r_text"))
    unit = F.when(F.col("field") == "fee", " lei").otherwise(" zile")
    shown = lambda s: F.struct(
        F.col(f"{s}_text.document_title").alias("document"),
        F.concat(F.col(f"{s}.amount"), unit).alias("value"),
        F.when(F.col("field") == "duration_days", F.array(F.col(f"{s}.amount").cast("int")))
        .otherwise(F.array().cast("array<int>")).alias("days"),
        F.col(f"{s}_text.quote").alias("quote"), F.col(f"{s}.url").alias("url"),
        F.col(f"{s}_text.page").cast("string").alias("page"),
        F.col(f"{s}.document_id").alias("document_id"),
    )
    ordered = [F.asc("l.pos"), F.asc("l.document_id"), F.asc("r.pos"), F.asc("r.document_id")]
    ranked = first_rows(pairs, ["query_id"], ordered, limit, "pair")
    return ranked.select("query_id", "field", "pair", shown("l").alias("left"), shown("r").alias("right"))
