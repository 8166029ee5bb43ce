"""Words are cut once and hashed once."""

import numpy as np
from pyspark.sql import functions as F

from quaero.operators import chunking, lexical


def test_words_of_a_search_are_cut_without_matches(spark):
    from quaero.functions.text import fold

    texts = ["", None, "  ", "Élan x-y_z; 漢字9 ½ 🙂áb\n--", "-a", "a-", "ﬁn Ünï²", "x" * 9, "\x00q\x00"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    both = rows.select(lexical.words_of("t").alias("cut"), F.regexp_extract_all(fold("t"), F.lit(lexical.WORD), F.lit(0)).alias("met"))
    assert all(r.cut == r.met for r in both.collect())
    assert "regexp_extract_all" not in rows.select(lexical.words_of("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_an_embedder_hashes_a_word_once(monkeypatch):
    made, plain = [], chunking.hashlib.blake2b

    def counted(word, digest_size):
        made.append(word)
        return plain(word, digest_size=digest_size)

    texts = ["the same words and The SAME words", "", "words and " * 50 + "x" * 99, " ".join(f"w{i}" for i in range(30)) * 2]
    wanted = np.zeros((4, 64))
    for row, text in zip(wanted, texts):
        for word in text.lower().split():
            digest = plain(word.encode(), digest_size=8).digest()
            row[int.from_bytes(digest[:4], "big") % 64] += 1 if digest[4] & 1 else -1
    monkeypatch.setattr(chunking.hashlib, "blake2b", counted)
    assert (chunking.hashed_words()(texts) == wanted).all() and made.count(b"words") == 1
    monkeypatch.setattr(chunking, "WORDS_KEPT", 3, raising=False)
    assert (chunking.hashed_words()(texts) == wanted).all()
