"""What the tokenizer's word cache needs beside its texts."""

import collections
import tracemalloc

import pytest


def test_an_encoder_holds_little_beside_its_texts():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from quaero.llm.encoding import WordEncoder

    encoder, texts = WordEncoder(path), [f"word{i % 50} and more text of {i % 90} " * 400 for i in range(500)]
    raw = [t.encode() for t in texts]
    tracemalloc.start()
    sizes = [len(ids) for ids in encoder.encode(raw)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sizes) == 500 and sizes[7] == len(encoder.tokenizer.encode(texts[7], add_special_tokens=False).ids)
    assert peak < 60e6


@pytest.mark.parametrize("slots", [4, 20])
def test_words_are_kept_in_bounded_arrays(monkeypatch, slots):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from quaero.llm import encoding

    monkeypatch.setattr(encoding, "SLOTS", slots)
    encoder, learned = encoding.WordEncoder(path), collections.Counter()
    learn = encoder.learn_latin
    encoder.learn_latin = lambda words: learned.update(words) or learn(words)
    letters, wide = "abcdefghijklmnopqrstuvwxyz", "qzxjkvwq" * 9
    for i in range(26):
        rare = " ".join(f"x{letters[i]}{a}{b}q" for a in letters[:10] for b in letters[:6])
        texts = ["", f"Often seen, {rare} {wide}{letters[i]}, a\x00b often seen Größe", " ", f"often {wide} {rare} don't 12", f"漢字 {rare}", "often"]
        found = [ids.tolist() for ids in encoder.encode([t.encode() for t in texts])]
        assert found == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    if slots == 20:
        assert learned[b"often"] == learned[b"seen"] == 1 and max(learned.values()) <= 52
    assert len(encoder.hashes) == len(encoder.ids) == 1 << slots and not any(k.isascii() and k.isalpha() and len(k) > 70 for k in encoder.known)
