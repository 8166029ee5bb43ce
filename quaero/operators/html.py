"""Main text, title and links of stored pages.

Only what needs the element tree runs in Python, batch by batch: the text
pieces of a page with two marks each, and its references. Clean-up, fallback,
ordering and joins are Spark expressions on top.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.functions.urls import is_document, is_pagination_hint, normalize_url, raw_path
from quaero.operators import cleaning
from quaero.values import words

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_PARAGRAPH = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
MAIN_BODY = ("main-article", "entry-content", "post-content")
MAIN_FRAME = ("single-article", "article-section")
MAIN_CLASSES = {
    "main-article", "entry-content", "post-content", "td-post-content", "single-post-content",
    "single-article", "article-section",
}
WIDGET, WIDGET_BODY = "elementor-widget-theme-post-content", "elementor-widget-container"
MIN_MAIN = 120
# Pages that a task holds in parts at a time, however many rows Spark hands out at once.
PAGES = 100
ANCESTORS = 8

PIECES = (
    "page_id long, url string, page_title string, h1 string, "
    "pieces array<struct<t:string, main:boolean, up:int>>, "
    "links array<struct<url:string, anchor:string>>, assets array<string>"
)

_STRUCT = lambda **fields: pa.list_(pa.struct(list(fields.items())))
READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("page_title", pa.string()), ("h1", pa.string()),
    ("pieces", _STRUCT(t=pa.string(), main=pa.bool_(), up=pa.int32())),
    ("links", _STRUCT(url=pa.string(), anchor=pa.string())), ("assets", pa.list_(pa.string())),
])


class _Node:
    __slots__ = ("name", "attrs", "parent", "items")

    def __init__(self, name: str, attrs: dict, parent: _Node | None):
        self.name, self.attrs, self.parent, self.items = name, attrs, parent, []

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def nodes(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.items) if isinstance(x, _Node))

    def texts(self) -> Iterator[str]:
        stack = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, _Node):
                stack.extend(reversed(item.items))
            elif item.strip():
                yield item.strip()

    def ancestors(self) -> Iterator[_Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_PARAGRAPH and self.at.name == "p" or tag == "li" and self.at.name == "li":
            self.at = self.at.parent
        node = _Node(tag, dict(attrs), self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.items.append(_Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.items.append(data)


def _is_chrome(node: _Node) -> bool:
    if node.name in words.CHROME_TAGS or node.name == "aside":
        return True
    # Headers always stay: one would only go for a menu inside it, and menus are gone by then.
    if node.name in ("header", "body", ""):
        return False
    ident = (node.attrs.get("id") or "").lower()
    if node.attrs.get("role") in words.CHROME_ROLES or ident in words.CHROME_IDS:
        return True
    if ident.startswith(tuple(words.CHROME_ID_PREFIXES)):
        return True
    marks = [c.lower() for c in node.classes() if c.lower() not in words.CHROME_EXEMPT_CLASSES]
    return any(
        c in words.CHROME_CLASSES or c.startswith(tuple(words.CHROME_CLASS_PREFIXES))
        or any(part in c for part in words.CHROME_CLASS_PARTS)
        for c in marks
    )


def _drop_chrome(root: _Node) -> None:
    doomed = {id(n) for n in root.nodes() if _is_chrome(n)}
    for node in list(root.nodes()):
        node.items = [x for x in node.items if not (isinstance(x, _Node) and id(x) in doomed)]


def _main(root: _Node) -> _Node:
    best, top = None, None
    for node in root.nodes():
        marks = set(node.classes())
        above = list(node.ancestors())
        chosen = (
            node.name == "article" or marks & MAIN_CLASSES or node.attrs.get("itemprop") == "articleBody"
            or (WIDGET in marks and any(a.name == "article" for a in above))
            or (WIDGET_BODY in marks and any(WIDGET in a.classes() for a in above))
        )
        size = sum(map(len, node.texts())) if chosen else 0
        if size < MIN_MAIN:
            continue
        joined = " ".join(node.classes()).lower()
        if any(m in joined for m in MAIN_BODY):
            size += 5000
        elif any(m in joined for m in MAIN_FRAME):
            size += 2000
        elif node.name == "article":
            size -= 500
        if top is None or size > top:
            best, top = node, size
    if best is not None:
        return best
    return next((n for n in root.nodes() if n.name == "body"), root)


def _references(root: _Node, page: str) -> tuple[list[dict], list[str]]:
    links, assets = [], []

    def add(ref: str | None, anchor: str) -> None:
        try:
            links.append({"url": urljoin(page, ref), "anchor": anchor[:120]})
        except (ValueError, TypeError):
            pass

    every = list(root.nodes())
    for node in every:
        href = (node.attrs.get("href") or "").strip()
        if node.name == "a" and "href" in node.attrs and not href.startswith(("mailto:", "tel:", "javascript:", "#")):
            add(href, " ".join(node.texts()) or node.attrs.get("aria-label") or node.attrs.get("title") or "")
    for node in every:
        if node.name in ("button", "div", "span") and "data-href" in node.attrs:
            add(node.attrs["data-href"], " ".join(node.texts()))
    for node in every:
        if node.name in ("iframe", "embed", "object"):
            for attr in ("src", "data"):
                if node.attrs.get(attr):
                    add(node.attrs[attr], "")
    for node in every:
        rel = " ".join((node.attrs.get("rel") or "").split()).lower()
        if node.name == "link" and node.attrs.get("href") and ("next" in rel or "prev" in rel):
            add(node.attrs["href"], rel)
    for kind in ("script", "link"):
        for node in every:
            ref = node.attrs.get("src" if kind == "script" else "href")
            if node.name != kind or not ref:
                continue
            try:
                found = urljoin(page, ref)
            except ValueError:
                continue
            low = found.lower()
            if kind == "script":
                asset = low.endswith((".js", ".mjs")) or ".js?" in low or "/js/" in low
            else:
                rel = (node.attrs.get("rel") or "").lower()
                asset = "stylesheet" in rel or low.endswith(".css") or ".css?" in low
            if asset:
                assets.append(found)
    return links, assets


def _read_page(page_id: int, url: str, body: str) -> dict:
    tree = _Tree()
    tree.feed(body or "")
    tree.close()
    root = tree.root
    links, assets = _references(root, url)
    _drop_chrome(root)
    title = next((n for n in root.nodes() if n.name == "title"), None)
    h1 = next((n for n in root.nodes() if n.name == "h1"), None)
    main = _main(root)
    level = {id(a): i + 1 for i, a in enumerate(h1.ancestors()) if i < ANCESTORS} if h1 else {}
    pieces = []
    stack = [(root, False, 99)]
    while stack:
        item, inside, up = stack.pop()
        if isinstance(item, _Node):
            inside, up = inside or item is main, min(up, level.get(id(item), 99))
            stack.extend((x, inside, up) for x in reversed(item.items))
        elif item.strip():
            pieces.append({"t": item.strip(), "main": inside, "up": up})
    # A tree whose nodes know their parents would stay until the next full collection.
    for node in list(root.nodes()):
        node.parent = None
    return {
        "page_id": page_id, "url": url,
        "page_title": "".join(title.texts()) if title else "",
        "h1": "".join(h1.texts()) if h1 else "",
        "pieces": pieces, "links": links, "assets": assets,
    }


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html) into READ, PAGES rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            some = batch.slice(at, PAGES)
            rows = [_read_page(*row) for row in zip(*(c.to_pylist() for c in some.columns))]
            yield pa.RecordBatch.from_pylist(rows, READ)


def page_pieces(pages: DataFrame) -> DataFrame:
    """``pages`` has (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(read_pages, PIECES)


def _main_text() -> Column:
    chosen = F.filter("pieces", lambda p: p["main"])
    return F.array_join(F.transform(chosen, lambda p: p["t"]), "\n")


def _around_heading(text: Column, pieces: Column) -> Column:
    """The longest text around the first heading; its ancestors are tried until 300 characters."""

    def around(level: Column) -> Column:
        near = F.filter(pieces, lambda p: p["up"] <= level)
        return cleaning.normalize_page_text(F.array_join(F.transform(near, lambda p: p["t"]), "\n"))

    def step(best: Column, level: Column) -> Column:
        longer = T.let(around(level), lambda x: F.when(F.length(x) > F.length(best), x).otherwise(best))
        return F.when((F.length(best) >= 300) & (level > 1), best).otherwise(longer)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ANCESTORS)), text, step)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, title, content, links, assets)`` of every page."""
    pieces = page_pieces(pages).withColumn(
        "_text", cleaning.scrub(cleaning.normalize_page_text(_main_text()))
    )
    short = (F.col("h1") != "") & (F.length("_text") < 200)
    content = F.when(short, _around_heading(F.col("_text"), F.col("pieces"))).otherwise(F.col("_text"))
    title = F.coalesce(
        F.nullif("h1", F.lit("")), F.nullif("page_title", F.lit("")),
        F.nullif(raw_path(F.col("url")), F.lit("")), F.col("url"),
    )
    return pieces.select(
        "page_id", "url", title.alias("title"), content.alias("content"),
        "links", asset_list().alias("assets"),
    )


def asset_list(limit: int = 40) -> Column:
    return F.slice(F.array_distinct(F.transform("assets", lambda a: normalize_url(a))), 1, limit)


def link_table(extracted: DataFrame) -> DataFrame:
    """``(page_id, page_url, url, anchor, link_pos)``: one row per page and address.

    The first anchor wins; documents come first, then pagination, then by address.
    """
    rows = extracted.select(
        "page_id", F.col("url").alias("page_url"), F.posexplode("links").alias("_at", "_link")
    ).select("page_id", "page_url", "_at", normalize_url("_link.url").alias("url"),
             F.col("_link.anchor").alias("anchor"))
    unique = rows.groupBy("page_id", "page_url", "url").agg(F.min_by("anchor", "_at").alias("anchor"))
    return order_links(unique)


def order_links(links: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    order = [
        (~is_document("url")).asc(), (~is_pagination_hint("url", "anchor")).asc(), F.asc("url"),
    ]
    return links.withColumn(
        "link_pos", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))
    )


