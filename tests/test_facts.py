"""Vacancies, deadlines and numeric contradictions on literal evidence."""

import datetime

import pytest
from pyspark.sql import functions as F

from quaero.operators import facts, questions

TODAY = datetime.date(2026, 9, 27)
HIT = (
    "query_id long, question string, pos int, chunk_id long, document_id long, document_title string, "
    "document_url string, content string, page int"
)
PERMIT = "Autorizația de demolare"
PERMIT_QUESTION = "Ce termen are autorizația de demolare?"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("r")).first()["r"]


def state(spark, text, title="Anunț concurs"):
    return one(spark, text, facts.vacancy_state(F.lit(title), F.col("x"), TODAY))


def pairs(spark, question, *documents):
    rows = [
        (1, question, i, i, i, title, f"https://example.org/{i}", text, 1)
        for i, (title, text) in enumerate(documents, 1)
    ]
    return facts.conflicts(spark.createDataFrame(rows, HIT)).orderBy("pair").collect()


@pytest.mark.parametrize("text", [
    "Termen de depunere a actelor 3 martie 2026",
    "Data limită 14 aprilie 2026",
    "Dosarele pot fi depuse până la 30 iunie 2026",
    "Termenul limită de înscriere: 2 septembrie 2026",
    "S-a prelungit: depunerea candidaturilor până la 20 august 2026",
])
def test_past_deadlines_are_expired(spark, text):
    assert state(spark, text) == "expired"


@pytest.mark.parametrize("text, wanted", [
    ("Postul a fost anunțat în primăvara lui 2026", "unverified"),
    ("Data limită: se va comunica", "unverified"),
    ("Data limită 27 septembrie 2026", "unverified"),
    ("Dosarele se primesc până la 09.11.2026", "open"),
    ("Data limită 3 martie 2026. Data limită 9 noiembrie 2026.", "unverified"),
    ("Data limită 30.02.2027", "unverified"),
    ("closing date 2027-01-15", "open"),
])
def test_vacancy_state(spark, text, wanted):
    assert state(spark, text) == wanted


@pytest.mark.parametrize("text, wanted", [
    ("data limită 7aprilie2026", [datetime.date(2026, 4, 7)]),
    ("Срок подачи: 5 ноября 2026", [datetime.date(2026, 11, 5)]),
    ("apply by\n2026-12-30", []),
    ("apply by 6 June 2027, closing date 2026-11-20", [datetime.date(2026, 11, 20), datetime.date(2027, 6, 6)]),
    ("", []),
])
def test_application_deadlines(spark, text, wanted):
    assert one(spark, text, facts.application_deadlines("x")) == wanted


def test_excerpt_keeps_the_deadline(spark):
    text = "Post vacant de jurist în Centru. " + "Sarcini. " * 380 + "Data limită: 9 noiembrie 2026."
    excerpt = one(spark, text, facts.vacancy_excerpt("x"))
    assert len(excerpt) <= 2200 and "9 noiembrie 2026" in excerpt and excerpt.startswith("Post vacant")
    assert one(spark, "scurt", facts.vacancy_excerpt("x")) == "scurt"
    assert one(spark, "a" * 3000, facts.vacancy_excerpt("x")) == "a" * 2200


def test_sector(spark):
    assert one(spark, "dar posturi vacante la sectorul Botanica?", facts.sector_in_question("x")) == "botanica"
    assert one(spark, "Centru sau Botanica?", facts.sector_in_question("x")) is None
    fits = lambda title, url, body: one(
        spark, body, facts.matches_sector(F.lit(title), F.lit(url), F.col("x"), F.lit("botanica")))
    assert not fits("Pretura sectorului Centru", "https://centru.md/posturi", "Data limită")
    assert fits("Pretura sectorului Botanica", "https://botanica.md/posturi", "Data limită")
    assert fits("Anunț", "https://x.md", "Pretura sectorului Botanica caută un jurist")
    assert not fits("Anunț", "https://x.md", "parcul Botanica")


def test_same_service_with_different_times(spark):
    found = pairs(
        spark, PERMIT_QUESTION,
        (PERMIT, "Se emite autorizația de demolare în termen de 15 zile lucrătoare."),
        ("Ghid: autorizația de demolare", "Termenul pentru autorizația de demolare este 25 zile lucrătoare."),
    )
    assert [(p.field, p.left.value, p.right.value) for p in found] == [("duration_days", "15 zile", "25 zile")]


def test_unrelated_services_and_versions(spark):
    permit = (PERMIT + " 2026", "Se emite autorizația de demolare în termen de 15 zile.")
    petition = ("Reclamații", "Termenul de răspuns la reclamații: 25 zile.")
    old = (PERMIT + " 2024", "Se emite autorizația de demolare în termen de 25 zile.")
    assert pairs(spark, PERMIT_QUESTION, permit, petition) == []
    assert pairs(spark, PERMIT_QUESTION, permit, old) == []
    assert pairs(spark, "Ce termen e?", permit, old) == []


@pytest.mark.parametrize("question", [
    "Cât costă licența de pescuit?", "Ce taxă are licența de pescuit?",
])
def test_fees(spark, question):
    found = pairs(
        spark, question,
        ("Licența de pescuit", "Taxa pentru licența de pescuit este 120,00 lei."),
        ("Licența de pescuit", "Taxa pentru licența de pescuit este 180,5 lei."),
    )
    assert [(p.field, p.left.value, p.right.value) for p in found] == [("fee", "120 lei", "180.5 lei")]


def test_ambiguous_documents_jobs_and_units(spark):
    mixed = (PERMIT, "Termenul de emitere: 15 zile. Serviciu express: 4 zile.")
    normal = (PERMIT, "Termenul de emitere: 25 zile.")
    assert pairs(spark, PERMIT_QUESTION, mixed, normal) == []
    job = ("Post vacant", "Termenul de înscriere: 8 zile.")
    assert pairs(spark, "Ce termen are concursul?", normal, job) == []
    working = (PERMIT, "Se emite autorizația de demolare în termen de 15 zile lucrătoare.")
    calendar = (PERMIT, "Se emite autorizația de demolare în termen de 25 zile calendaristice.")
    assert pairs(spark, PERMIT_QUESTION, working, calendar) == []


def test_first_pairs_of_many_documents(spark):
    """The bounded pair search against every pair, on a group with few values, years and addresses."""
    import itertools
    import random

    rng = random.Random(5)
    documents = []
    for i in range(1, 121):
        year = rng.choice(["", "", " 2024", " 2025"])
        value = rng.choice([20, 20, 20, 20, 20, 30]) if i < 100 else rng.choice([20, 30, 40])
        url = rng.choice([f"https://example.org/{i}", "https://example.org/same", ""])
        documents.append((i, PERMIT + year, url, value))
    rows = [
        (1, PERMIT_QUESTION, i, i, i, title, url, f"Se emite autorizația de demolare în termen de {v} zile.", 1)
        for i, title, url, v in documents
    ]
    found = facts.conflicts(spark.createDataFrame(rows, HIT)).orderBy("pair").collect()
    expected = []
    for (i, ta, ua, va), (j, tb, ub, vb) in itertools.combinations(documents, 2):
        ya, yb = ta[-4:] if "20" in ta else None, tb[-4:] if "20" in tb else None
        if va != vb and not (ua and ua == ub) and not (ya and yb and ya != yb):
            expected.append((i, j))
    assert [(p.left.document_id, p.right.document_id) for p in found] == expected[:3]


def test_contact_fields(spark):
    text = "Telefon 022 11-22-33, 022 11-22-33; Office@Prim.md, z@q.md; str. Florilor nr. 7, Orhei"
    rows = spark.createDataFrame(
        [(1, "q", 1, 1, 1, "Contact", "u", text, 1)], HIT)
    known = spark.createDataFrame([(1, "z@q.md")], "query_id long, email string")
    found = facts.contact_fields(rows, known).first()
    assert found.phones == ["022 11-22-33"]
    assert found.emails == ["z@q.md", "office@prim.md"]
    assert found.addresses == ["str. Florilor nr. 7"]


def test_dates_and_durations(spark):
    text = "Emis 01.02.2026 și 2026-03-04, 5 mai 2026; 20 zile lucrătoare, 20 zile lucrătoare, 3 zile"
    rows = spark.createDataFrame([(1, "q", 1, 1, 1, "T", "u", text, 1)], HIT)
    found = facts.dates_and_durations(rows).first()
    assert found.dates == ["01.02.2026", "2026-03-04", "5 mai 2026"]
    assert found.deadlines == ["20 zile lucrătoare", "3 zile"]


def test_intent_of_the_examples(spark):
    intents = {
        PERMIT_QUESTION: "deadline", "Există vreun concurs anunțat acum?": "concurs",
        "dar posturi vacante la sectorul Botanica?": "concurs", "Есть конкурсы на службу сейчас?": "concurs",
        "Unde găsesc telefonul primăriei?": "general", "La ce telefon răspunde primăria?": "contact",
        "Cum prelungesc autorizația?": "autorizatie",
    }
    for question, wanted in intents.items():
        assert one(spark, question, questions.intent("x")) == wanted, question
    for question in ("Există vreun concurs anunțat acum?", "Есть конкурсы на службу сейчас?",
                     "dar posturi vacante la sectorul Botanica?"):
        assert one(spark, question, questions.wants_current("x")), question


@pytest.mark.parametrize("crowded", [50_000, 60])
def test_first_pairs_of_many_hits(spark, monkeypatch, crowded):
    """Documents of several hits, some unclear, some under several questions of one id; laid out by question and by parts."""
    import itertools
    import random

    monkeypatch.setattr(facts, "CROWDED", crowded)
    monkeypatch.setattr(facts, "PARTS", 3)
    rng = random.Random(7)
    fee = "Ce taxă are autorizația de demolare?"
    rows, stated, place = [], {}, {}
    for i in range(1200):
        query, doc = rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(1, 300)])
        question, unit = rng.choice([(PERMIT_QUESTION, "zile"), (PERMIT_QUESTION, "zile"), (fee, "lei"), ("Cine?", "zile"), (None, "zile")])
        n = (doc or 0) % 3 + 20 + (rng.random() < 0.05)
        year, url = ["", " 2024", " 2025"][(doc or 0) % 7 % 3], [f"u{doc}", "same", "", None][(doc or 0) % 5 % 4]
        said = rng.random() < 0.8
        pos = rng.randrange(40)
        rows.append((query, question, pos, i, doc, PERMIT + year, url, f"Autorizația de demolare: emitere, taxă, termen {n} {unit}." if said else "Altele.", i))
        if query and doc:
            place[query, doc] = min(pos, place.get((query, doc), 99))
            if said and question in (PERMIT_QUESTION, fee):
                stated.setdefault((query, doc, unit), []).append((n, pos, i, year, url))
    clear = {k: min(v, key=lambda s: s[1:3]) for k, v in stated.items() if len({s[0] for s in v}) == 1}
    expected = []
    for query in (1, 2, 3):
        pairs = []
        for ((q, a, u), x), ((r, b, v), y) in itertools.permutations([c for c in clear.items() if c[0][0] == query], 2):
            left, right = (place[q, a], a), (place[r, b], b)
            if u == v and left < right and x[0] != y[0] and not (x[4] and x[4] == y[4]) and not (x[3] and y[3] and x[3] != y[3]):
                pairs.append((*left, *right, f"{x[0]} {u}", f"{y[0]} {v}", str(x[2]), str(y[2])))
        expected += [(query, k, p[1], p[3], *p[4:]) for k, p in enumerate(sorted(pairs)[:3], 1)]
    found = facts.conflicts(spark.createDataFrame(rows, HIT)).collect()
    assert sorted(
        (r.query_id, r.pair, r.left.document_id, r.right.document_id, r.left.value, r.right.value, r.left.page, r.right.page) for r in found
    ) == expected and len(expected) == 9
    told = facts.clear_claims(spark.createDataFrame(rows, HIT)).collect()
    assert {(t.query_id, t.document_id, "lei" if t.field == "fee" else "zile"): (t.amount, t.pos, t.page) for t in told} == {
        k: (str(v[0]), place[k[:2]], v[2]) for k, v in clear.items()
    }
