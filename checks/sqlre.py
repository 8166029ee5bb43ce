"""Patterns as the SQL engine reads them: its word classes only know ASCII letters."""

from __future__ import annotations

EDGE = r"[^\p{L}\p{N}_]"


def re2(pattern: str) -> str:
    """A pattern for a yes-or-no match, word borders and classes widened to all letters."""
    text = pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace("(?!chi)", "")
    out, at = "", 0
    while at < len(text):
        if text.startswith(r"\b", at):
            before = out == "" or out.endswith(("(?:", "|"))
            out += f"(?:^|{EDGE})" if before else f"(?:$|{EDGE})"
            at += 2
        else:
            out += text[at]
            at += 1
    return out


def like(column: str, pattern: str) -> str:
    """SQL for "does the column match", without regard to case."""
    return f"regexp_matches(coalesce({column}, ''), '(?i){sql_text(re2(pattern))}')"


def sql_text(value: str) -> str:
    return value.replace("'", "''")
