"""The index of pieces of characters is laid out by cell."""

from quaero.operators import gram_index
from quaero.operators.gram_index import GramIndex


def test_pieces_of_characters_beyond_the_basic_plane_and_of_long_texts(spark, tmp_path, monkeypatch):
    text = "ab😀c ab\x00"
    assert [len(gram_index._grams(text.encode(), n)) for n in (1, 2, 3)] == [6, 6, 6]
    monkeypatch.setattr(gram_index, "BLOCK", 3)
    assert [len(gram_index._grams(text.encode(), n)) for n in (1, 2, 3, 9)] == [6, 6, 6, 0]
    index = GramIndex(spark, str(tmp_path))
    chunks = spark.createDataFrame([(1, "x 😀😃 y"), (2, "😀 😃"), (3, None), (4, "AB😀cd")], "chunk_id long, content string")
    index.add(chunks)
    needles = spark.createDataFrame([("😀😃",), ("x 😀😃 y",), ("b😀cd",), ("😃",), ("",), ("b😀ce",)], "needle string")
    found = {(r.needle, r.chunk_id) for r in index.first_holding(needles, chunks, 5).collect()}
    assert found == {("😀😃", 1), ("x 😀😃 y", 1), ("b😀cd", 4), ("😃", 1), ("😃", 2)}
