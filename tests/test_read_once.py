"""Texts are cleaned once, and looked through for end lines once."""

from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators import cleaning, versioning
from quaero.values import patterns


def test_arrivals_are_cleaned_once(spark):
    text = "Un text destul de lung pentru a fi păstrat aici.\nOrganigrama\n12\nși încă un rând"
    fetched = spark.createDataFrame(
        [("a", "t", "scurt", 1), ("b", "t1", text, 1), ("b", "t2", text + " nou", 2), ("c", "t", None, 1), ("d", "t", "Organigrama\n" * 9, 1)],
        "url string, title string, content string, seq long",
    )
    found = versioning.prepare(fetched)
    assert found.columns == ["url", "title", "content", "seq", "content_hash"]
    kept = "Un text destul de lung pentru a fi păstrat aici.\nși încă un rând nou"
    assert [tuple(r)[:4] for r in found.collect()] == [("b", "t2", kept, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Secretarul-Preturii") == 1


def test_texts_are_cut_as_by_each_end_line_alone(spark):
    marks = [*patterns.EARLY_END_LINES, *patterns.LATE_END_LINES]
    long = "Un rând al paginii, destul de lung ca să treacă de prag. " * 3
    texts = [f"{head}\n{m}\nrest" for m in [*marks, "SHARE:", "Share", "tags:x", ""] for head in ("scurt", long)]
    texts += [None, "", "Share:", "\nComments\n", f"{long}\nVezi toate\nx\nTags:\ny", "Tags:\nx\n12345\n\n123456\n7", f"a\nShare:\n{long}\nShare:\nb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    text = F.coalesce("t", F.lit(""))
    at = F.least(cleaning._first_of(text, patterns.EARLY_END_LINES), cleaning._first_late(text))
    plain = T.strip(F.when(at.isNotNull(), F.substring(text, F.lit(1), at - 1)).otherwise(text))
    both = rows.select(cleaning.cut_after_end("t").alias("cut"), plain.alias("plain"), cleaning.scrub("t").alias("scrubbed")).collect()
    assert all(r.cut == r.plain for r in both)
    assert {r.cut for r in both} >= {"scurt", long.strip()} and both[-2].scrubbed == "Tags:\nx\n\n123456"
