"""The fair order against a crawler's loop; pages; incremental indexing."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quaero.operators import frontier, html
from quaero.plans import crawl, index
from quaero.streaming import ingest


def sequential_pops(items):
    """One pop after another: the host served least, ties to the better head."""
    queues = defaultdict(list)
    for host, priority, depth, seq in sorted(items, key=lambda x: (x[1], x[2], x[3])):
        queues[host].append((priority, depth, seq))
    served, order = defaultdict(int), []
    while any(queues.values()):
        host = min((h for h in queues if queues[h]), key=lambda h: (served[h], queues[h][0][0], queues[h][0][1:]))
        order.append(queues[host].pop(0)[2])
        served[host] += 1
    return order


def test_fair_order_equals_the_loop(spark):
    rng = random.Random(4)
    items = [(rng.choice(["big"] * 5 + ["x", "y", "z"]), rng.randint(0, 3) * 10, rng.randint(0, 2), i) for i in range(60)]
    rows = spark.createDataFrame(
        [(f"https://{h}.example.org/{s}", p, d, s) for h, p, d, s in items], "url string, priority int, depth int, seq long"
    )
    wanted = sequential_pops(items)
    ordered = frontier.fair_order(rows).orderBy("turn", "priority", "depth", "seq").collect()
    assert [r.seq for r in ordered] == wanted
    assert [r.seq for r in frontier.pop(rows, 17).orderBy("turn", "priority", "depth", "seq").collect()] == wanted[:17]


PAGE = """<html><head><title> T </title><link rel="next" href="/p2"><script src="/a/x.js"></script>
<link rel="stylesheet" href="s.css"></head><body class="no-sidebar"><header><nav>Menu</nav><b>Antet</b></header>
<a href="mailto:x@y">m</a><a href="/doc.pdf#a">Doc</a><a href="/doc.pdf">Altul</a><a aria-label="Etichetă" href="z"></a>
<div data-href="/ascuns">Ascuns</div><iframe src="/cadru"></iframe><div class="sidebar">Lateral</div>
<div class="entry-content"><h1>Titlu</h1><p>%s</p><div id="menu-x">Meniu</div><p>Distribuie:</p></div>
<article>%s</article><footer>Subsol</footer></body></html>"""


def test_page_extraction(spark):
    rows = [
        (1, "https://h.example.org/d/p1", PAGE % ("Text bun. " * 20, "Articol " * 40)),
        (2, "https://h.example.org/", "<html><body><div><h1>Scurt</h1></div><p>Altceva</p></body></html>"),
        (3, "https://h.example.org/gol", ""),
    ]
    got = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].title == "Titlu"
    assert got[1].content.startswith("Titlu\nText bun.") and "Meniu" not in got[1].content and "Articol" not in got[1].content
    assert got[1].assets == ["https://h.example.org/a/x.js", "https://h.example.org/d/s.css"]
    assert got[2].title == "Scurt" and got[2].content == "Scurt\nAltceva"
    assert got[3].title == "/gol" and got[3].content == ""
    table = html.link_table(spark.createDataFrame([got[1]])).orderBy("link_pos").collect()
    assert [(r.url, r.anchor) for r in table] == [
        ("https://h.example.org/doc.pdf", "Doc"), ("https://h.example.org/p2", "next"),
        ("https://h.example.org/ascuns", "Ascuns"), ("https://h.example.org/cadru", ""),
        ("https://h.example.org/d/z", "Etichetă"),
    ]


def page(body):
    return f"<html><body><article><h1>Anunț</h1><p>{body}</p></article></body></html>"


LONG = "Un text destul de lung pentru a fi păstrat în index, cu toate detaliile. " * 3


def fetched(spark, *rows):
    return spark.createDataFrame(
        [(i, u, u, s, "text/html", b) for i, (u, s, b) in enumerate(rows)], ingest.FETCHED_SCHEMA
    )


def test_batches_of_pages(spark, tmp_path):
    landing, path = str(tmp_path / "landing"), str(tmp_path / "index")

    def run(*rows):
        fetched(spark, *rows).coalesce(1).write.mode("append").parquet(landing)
        query = ingest.ingest_stream(spark, landing, path, str(tmp_path / "checkpoint"))
        query.awaitTermination()

    a, b = "https://h.example.org/a", "https://h.example.org/b"
    run((a, 200, page(LONG)), (b, 200, page(LONG + "B")))
    first = {r.url: r.content_hash for r in ingest.current_documents(spark, path).collect()}
    assert set(first) == {a, b} and ingest.current_chunks(spark, path).count() == 2
    run((a, 200, page(LONG)), (b, 200, page(LONG + "nou")))
    second = {r.url: r.content_hash for r in ingest.current_documents(spark, path).collect()}
    assert second[a] == first[a] and second[b] != first[b]
    assert ingest.current_chunks(spark, path).count() == 2
    changes = spark.read.parquet(f"{path}/changes").collect()
    assert [(c.url, c.old_hash, c.new_hash) for c in changes] == [(b, first[b], second[b])]
    run((b, 404, ""))
    assert [r.url for r in ingest.current_documents(spark, path).collect()] == [a]
    assert ingest.current_chunks(spark, path).count() == 1


def test_index_update_twice_changes_nothing(spark):
    import datetime

    empty = spark.createDataFrame([], index.DOCUMENT_SCHEMA), spark.createDataFrame([], index.CHUNK_SCHEMA)
    rows = fetched(spark, ("https://h.example.org/a", 200, page(LONG)), ("https://h.example.org/c", 200, page("404 not found")))
    now = datetime.datetime(2026, 1, 1)
    one = index.update(rows, *empty, now)
    documents = spark.createDataFrame(one.documents.collect(), index.DOCUMENT_SCHEMA)
    chunks = spark.createDataFrame(one.chunks.collect(), index.CHUNK_SCHEMA)
    assert documents.count() == 1 and chunks.count() == 1
    two = index.update(rows, documents, chunks, now)
    assert two.changes.count() == 0 and two.chunks.exceptAll(chunks).count() == 0
    assert {r.status for r in two.status.collect()} == {"unchanged"}


@pytest.mark.parametrize("max_depth, wanted", [(0, {"a": 0}), (1, {"a": 0, "b": 1, "c.pdf": 2}), (5, {"a": 0, "b": 1, "c.pdf": 2, "d": 2})])
def test_traversal(spark, max_depth, wanted):
    name = lambda x: f"https://h.example.org/{x}"
    links = spark.createDataFrame(
        [(name(x), name(y)) for x, y in (("a", "b"), ("b", "c.pdf"), ("b", "d"), ("d", "a"))], "page_url string, url string"
    )
    got = frontier.crawl(links, spark.createDataFrame([(name("a"),)], "url string"), max_depth)
    assert {r.url.rsplit("/", 1)[1]: r.depth for r in got.collect()} == wanted


def test_page_budget(spark):
    links = spark.createDataFrame([("https://h.example.org/a", f"https://h.example.org/{i}") for i in range(9)], "page_url string, url string")
    got = frontier.crawl(links, spark.createDataFrame([("https://h.example.org/a",)], "url string"), 3, max_pages=4)
    assert got.count() == 4 and got.filter(F.col("depth") == 0).count() == 1


def simulated(pages, links, seeds, hosts, sitemaps, max_pages, max_depth, batch):
    """The same crawl one row at a time."""
    document = lambda u: u.endswith(".pdf")
    host = lambda u: u.split("/")[2]
    allowed = lambda u: any(host(u) == h or host(u).endswith("." + h) for h in hosts)
    slashes = lambda u: u.rstrip("/").count("/")
    rank = lambda u, d: d - 20 if document(u) else 40 + d * 8 - (5 if slashes(u) <= 3 else 0)
    seen, frontier, served, out = set(), {}, {}, []

    def enter(found):
        least = {}
        for u, d in found:
            if u not in seen and (d <= max_depth or document(u)):
                least[u] = min(d, least.get(u, d))
        seen.update(least)
        frontier.update(least)

    enter([(u, 0) for u in seeds if allowed(u)])
    turn = 0
    while frontier and len(out) < max_pages:
        turn += 1
        rows = []
        for h in {host(u) for u in frontier}:
            own = sorted((rank(u, d), d, u) for u, d in frontier.items() if host(u) == h)
            rows += [(served.get(h, 0) + i, *r) for i, r in enumerate(own)]
        now = [(u, d) for _, _, d, u in sorted(rows)[: min(batch, max_pages - len(out))]]
        out += [(u, d, turn, i) for i, (u, d) in enumerate(now, 1)]
        found = [(v, d + 1) for u, d in now if pages.get(u, 500) < 400 for v in links.get(u, []) if allowed(v) and "/cart" not in v]
        for h in {host(u) for u, _ in now} - set(served):
            found += [(u, 1) for u in sitemaps.get(h, []) if allowed(u)]
        for u, _ in now:
            del frontier[u]
            served[host(u)] = served.get(host(u), 0) + 1
        enter(found)
    return out


@pytest.mark.parametrize("batch, max_pages", [(1, 25), (4, 40), (1000, 1000), (7, 60)])
def test_crawl_job_equals_a_simulation(spark, batch, max_pages):
    rng = random.Random(batch)
    # One host owns most pages; one lies below an allowed host, one is not allowed.
    hosts = ["big.org"] * 6 + ["small.org", "sub.small.org", "other.net"]
    names = [f"https://{h}/{'cart/' if i % 23 == 0 else ''}p{i}{'.pdf' if i % 7 == 0 else ''}" for i, h in enumerate(rng.choice(hosts) for _ in range(120))]
    pages = {u: 404 if i % 11 == 0 else 200 for i, u in enumerate(names) if i % 13}
    links = {u: rng.sample(names, 4) for u in names}
    sitemaps = {"small.org": rng.sample(names, 6), "big.org": rng.sample(names, 3)}
    seeds = [u for u in names if "cart" not in u][:3] + ["https://nowhere.net/x"]
    allow = ["big.org", "small.org"]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = crawl.crawl_job(
        frame(list(pages.items()), "url string, status int"), frame([(u, v) for u, vs in links.items() for v in vs], "page_url string, url string"),
        frame([(u,) for u in seeds], "url string"), frame([(h,) for h in allow], "host string"),
        frame([(h, u) for h, us in sitemaps.items() for u in us], "host string, url string"), max_pages, 3, batch,
    )
    assert sorted((r["round"], r.place, r.url, r.depth) for r in got.collect()) == sorted(
        (turn, i, u, d) for u, d, turn, i in simulated(pages, links, seeds, allow, sitemaps, max_pages, 3, batch)
    )
