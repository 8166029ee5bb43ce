"""Text clean-up and page classification in built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.functions.urls import raw_path
from quaero.values import patterns, words

LATE_END_AFTER = 80


def _keep_lines(c: Column, drop) -> Column:
    """The text's stripped lines without those that ``drop`` names; empty ones stay."""
    stripped = F.transform(T.lines(c), T.strip)
    return F.array_join(F.filter(stripped, lambda s: (s == "") | ~drop(s)), "\n")


def _first_of(c: Column, end_lines: list[str]) -> Column:
    """1-based position of the line break before the first such line, or null."""
    pattern = "\n(?:" + "|".join(re.escape(m) for m in end_lines) + ")\n"
    at = F.regexp_instr(c, F.lit(T.uni(pattern)))
    return F.when(at > 0, at)


def _first_late(c: Column) -> Column:
    """Each late marker counts by its first place only, and only past the threshold."""
    found = [_first_of(c, [m]) for m in dict.fromkeys(m.lower() for m in patterns.LATE_END_LINES)]
    return F.least(*[F.when(at - 1 > LATE_END_AFTER, at) for at in found])


def cut_after_end(c: Column | str) -> Column:
    """The text before the first line that ends the page's own content."""

    def cut(text: Column) -> Column:
        # Few texts have such a line at all: one look tells them from the others.
        ends = F.least(_first_of(text, patterns.EARLY_END_LINES), _first_late(text))
        return T.let(
            F.when(_first_of(text, [*patterns.EARLY_END_LINES, *patterns.LATE_END_LINES]).isNotNull(), ends),
            lambda at: T.strip(F.when(at.isNotNull(), F.substring(text, F.lit(1), at - 1)).otherwise(text)),
        )

    return T.let(T.text_or_empty(c), cut)


def _matches_any(s: Column, line_patterns: list[str]) -> Column:
    return s.rlike(T.uni("|".join(f"(?:{p})" for p in line_patterns)))


def normalize_page_text(c: Column | str) -> Column:
    """Spaces and blank lines reduced; placeholders, widget lines and what follows the end go."""
    text = F.regexp_replace(T.text_or_empty(c), "[ \t]+", " ")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    for placeholder in patterns.PLACEHOLDERS:
        text = F.regexp_replace(text, T.uni(placeholder), "")
    dropped = [patterns.READ_MORE_LINE, patterns.SHARE_LINE, patterns.DOWNLOAD_LINE, patterns.FILE_SIZE_LINE]
    return cut_after_end(T.strip(_keep_lines(text, lambda s: _matches_any(s, dropped))))


def scrub(c: Column | str) -> Column:
    """Without leftover menu lines, short menu blobs and bare numbers."""

    def drop(s: Column) -> Column:
        return (
            ((F.length(s) <= 42) & s.rlike(T.uni(patterns.MENU_LINE)))
            | ((F.length(s) < 120) & s.rlike(T.uni(patterns.MENU_BLOB)))
            | ((F.length(s) <= 7) & s.rlike("(?U)" + patterns.NUMBER_LINE))
        )

    kept = cut_after_end(_keep_lines(T.text_or_empty(c), drop))
    return T.strip(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def is_http_error(status: Column) -> Column:
    return status >= 400


def is_soft_404(status: Column, title: Column, content: Column) -> Column:
    """A page that says it does not exist, whatever its status."""
    heading = F.lower(T.strip(T.text_or_empty(title)))
    body = T.text_or_empty(content)
    head = F.concat(T.text_or_empty(title), F.lit("\n"), F.substring(body, 1, 2500))
    hits = F.regexp_count(head, F.lit(T.uni(patterns.DEAD_PAGE)))
    size = F.length(T.strip(body))
    return (
        is_http_error(status)
        | heading.isin(words.DEAD_TITLES)
        | heading.startswith("404")
        | (
            (hits > 0)
            & ((hits >= 2) | (size < 400) | heading.contains("not found")
               | ((size < 800) & T.matches(title, patterns.DEAD_PAGE)))
        )
    )


def content_kind(content_type: Column, final_url: Column, body: Column) -> Column:
    """html, pdf, docx, doc, xlsx, xls, other_doc or skip, from type, path and first bytes."""
    kind = F.lower(T.text_or_empty(content_type))
    path = F.lower(raw_path(T.text_or_empty(final_url)))
    text = T.text_or_empty(body)
    head = F.lower(F.btrim(F.substring(text, 1, 200), F.lit(T.SPACES)))
    document = T.ends_with_any(path, words.DOCUMENT_EXTENSIONS)
    may_be_html = (
        kind.contains("text/html")
        | T.ends_with_any(path, [".html", ".htm", ".php", ".aspx"])
        | (~document & kind.startswith("text/"))
    )
    looks_html = head.startswith("<!doctype") | head.contains("<html")
    return (
        F.when(may_be_html & (looks_html | kind.contains("text/html")), "html")
        .when(kind.contains("pdf") | path.endswith(".pdf"), "pdf")
        .when(kind.contains("wordprocessingml") | path.endswith(".docx"), "docx")
        .when(path.endswith(".doc") | kind.contains("msword"), "doc")
        .when(path.endswith(".xlsx") | kind.contains("spreadsheetml"), "xlsx")
        .when(path.endswith(".xls") | kind.contains("excel"), "xls")
        .when(document, "other_doc")
        .when(F.lower(F.substring(text, 1, 2000)).contains("<html"), "html")
        .otherwise("skip")
    )


def polluted_documents(documents: DataFrame, limit: int | None = 200) -> DataFrame:
    """HTML documents whose text still holds menus: candidates for another extraction."""
    found = documents.filter(
        (T.like_any(F.col("content"), patterns.POLLUTED_CONTENT_LIKE)
         | T.like_any(F.col("title"), patterns.POLLUTED_TITLE_LIKE))
        & F.col("url").isNotNull() & (F.col("mime_type") == "text/html")
        & T.strip(F.col("url")).startswith("http")
    )
    return found if limit is None else found.orderBy("document_id").limit(limit)
