"""URL functions: generic syntax by regular expression, never a strict parser."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaero.functions.text import contains_any, ends_with_any, matches, strip, text_or_empty
from quaero.values import patterns, words

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
REST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, REST + r"//([^/?#]*)", 1)


def raw_path(url: Column) -> Column:
    """The path without the parameters of its last segment."""
    whole = F.regexp_extract(url, REST + r"(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(whole, r"^((?:.*/)?[^/;]*);[^/]*$", "$1")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def normalize_url(url: Column | str) -> Column:
    """Trimmed, without fragment, host in lower case, ``https`` and ``/`` by default."""
    u = F.regexp_replace(strip(text_or_empty(url)), r"(?s)#.*$", "")
    path = raw_path(u)
    parameters = query(u)
    return F.concat(
        F.when(scheme(u) == "", F.lit("https")).otherwise(scheme(u)),
        F.lit("://"),
        F.lower(authority(u)),
        F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "/{2,}", "/"),
        F.when(parameters == "", F.lit("")).otherwise(F.concat(F.lit("?"), parameters)),
    )


def host(url: Column | str) -> Column:
    """The authority in lower case without a leading ``www.``."""
    return F.regexp_replace(F.lower(authority(text_or_empty(url))), r"^www\.", "")


def source_code(url: Column | str) -> Column:
    """A slug of host and path, at most 64 characters."""
    u = text_or_empty(url)
    name = F.replace(host(u), F.lit("."), F.lit("-"))
    path = F.substring(
        F.replace(F.btrim(raw_path(u), F.lit("/")), F.lit("/"), F.lit("-")), 1, 40
    )
    joined = F.when(path != "", F.concat(name, F.lit("-"), path)).otherwise(name)
    slug = F.lower(F.btrim(F.regexp_replace(joined, "[^a-zA-Z0-9_-]+", "-"), F.lit("-")))
    return F.when(slug != "", F.substring(slug, 1, 64)).otherwise(F.substring(name, 1, 64))


def is_document(url: Column | str) -> Column:
    return ends_with_any(F.lower(raw_path(text_or_empty(url))), words.DOCUMENT_EXTENSIONS)


def is_crawlable(url: Column | str) -> Column:
    """A web address whose path is not an asset or an endpoint without content."""
    u = text_or_empty(url)
    return u.rlike("^https?://") & ~contains_any(F.lower(raw_path(u)), words.SKIPPED_PATH_PARTS)


def crawl_priority(url: Column | str, depth: Column) -> Column:
    """Lower comes first; documents always do."""
    u = F.lower(text_or_empty(url))
    slashes = F.length(F.regexp_replace(F.rtrim(u, F.lit("/")), "[^/]", ""))
    score = (
        40 + depth * 8
        - F.when(contains_any(u, words.PRIORITY_WORDS), 20).otherwise(0)
        - F.when(contains_any(u, words.ANNOUNCEMENT_WORDS), 15).otherwise(0)
        - F.when(slashes <= 3, 5).otherwise(0)
    )
    return F.when(is_document(url), depth - 20).otherwise(score).cast("int")


def is_pagination_hint(url: Column | str, anchor: Column | str) -> Column:
    blob = F.lower(F.concat_ws(" ", text_or_empty(url), text_or_empty(anchor)))
    return matches(anchor, patterns.PAGING_ANCHOR) | blob.rlike(patterns.PAGING_URL)


def is_useful_reference(ref: Column) -> Column:
    """A reference that may lead to a page rather than to an asset."""
    bare = F.regexp_replace(F.lower(ref), r"(?s)\?.*$", "")
    prefixes = "^(?:" + "|".join(re.escape(p) for p in patterns.USELESS_URL_PREFIXES) + ")"
    return (bare != "") & ~bare.rlike(prefixes) & ~ends_with_any(bare, words.ASSET_EXTENSIONS)


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
    """A reference made absolute against its page; null when it cannot be read."""
    from urllib.parse import urljoin

    def join(b: str, r: str) -> str | None:
        try:
            return urljoin(b, r)
        except ValueError:
            return None

    return pd.Series([join(b, r) for b, r in zip(base, ref)], dtype="object")
