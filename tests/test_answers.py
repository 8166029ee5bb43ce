"""A small corpus with a planted contradiction, a contact page and a vacancy, end to end."""

import datetime

from pyspark.sql import functions as F

from quaero.operators import chunking
from quaero.plans.answer import answer_batch
from quaero.plans.search import Corpus

TODAY = datetime.date(2026, 9, 27)
DOCUMENTS = [
    (1, "Autorizația de construire: ghid pentru solicitanți", "https://a.example.org/ghid",
     "Termen de eliberare a autorizației de construire: 20 zile lucrătoare de la depunerea cererii complete. "
     "Dosarul pentru autorizația de construire cuprinde certificatul de urbanism și proiectul."),
    (2, "Regulament privind autorizația de construire", "https://b.example.org/regulament",
     "Autorizația de construire se emite în termen de 30 zile lucrătoare. Regulamentul stabilește termenul de "
     "eliberare a autorizației de construire și actele cerute solicitantului."),
    (3, "Pretura sectorului Ciocana: anunț concurs specialist", "https://ciocana.example.org/concurs",
     "Anunț privind concursul pentru ocuparea funcției publice de specialist în sectorul Ciocana. "
     "Dosarele pot fi depuse până la data de 01.10.2026."),
    (4, "Parcuri și spații verzi", "https://c.example.org/parcuri",
     "Lucrări de amenajare a parcurilor din oraș au fost planificate pentru primăvară, cu pomi și bănci noi."),
]
QUESTIONS = [
    (1, "În câte zile se dă o autorizație de construire, care e termenul?"),
    (2, "Ce concursuri deschise sunt acum în sectorul Ciocana?"),
    (3, "Cine ești tu?"),
    (4, "Care este taxa pentru licența de pescuit a primăriei?"),
    (5, "Date de contact pretura Botanica"),
]


def test_batch_of_questions(spark):
    documents = spark.createDataFrame(DOCUMENTS, "document_id long, title string, url string, content string").withColumn(
        "mime_type", F.lit("text/html")
    )
    chunks = chunking.embed(chunking.chunk_table(documents), "content")
    links = spark.createDataFrame(
        [(1, "parcări rezidențiale", "парковка", "https://a.example.org/p", "Parcări", "tel")],
        "link_id long, topic_ro string, topic_ru string, url string, contact_label string, contact_value string",
    )
    asked = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    done = answer_batch(Corpus(documents, chunks, links), asked, TODAY, assistant="Bot")
    rows = {r.query_id: r for r in done.response.collect()}
    assert rows[1].status == "conflict"
    assert {rows[1].conflicts[0].left.value, rows[1].conflicts[0].right.value} == {"20 zile", "30 zile"}
    assert rows[2].status == "supported" and rows[2].sources[0].url == "https://ciocana.example.org/concurs"
    assert rows[3].status == "out_of_scope" and "Bot" in rows[3].answer
    assert rows[4].status == "missing"
    assert rows[5].status == "supported" and "pretura.botanica@pmc.md" in rows[5].answer
    assert rows[5].next_action.label == "Pretura sectorului Botanica"
