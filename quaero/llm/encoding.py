"""A tokenizer behind a cache of what it gives for single words.

The tokenizer of word_bpe_49k.json drops white space, parts texts by a fixed pattern and never joins what that parts, so a
text's ids are those of its words, one after the other. Texts of Latin letters are parted here by the same pattern, many at a
time, others at ASCII white space. Words unknown to bounded caches of the Python worker are encoded, many at once. Words of Latin
letters are looked up in arrays, a block's words at a time, by their hash and their first bytes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Words that a worker keeps; beyond it starts afresh, so its memory stays bounded.
CACHED = 500_000
# Two to this power words of Latin letters are kept, of at most so many ids each; a newer word takes an older one's place.
SLOTS, WIDEST = 20, 8
# Longer words are encoded but not kept.
LONGEST = 64
# Bytes of text that are parted at a time; a worker holds some hundred bytes for each of them.
BLOCK = 1 << 18
# Texts of these characters alone are parted by their bytes: ASCII and Latin letters that have one lower-case letter each.
LATIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-įı-ſ]*")
# What the tokenizer's pattern tells apart: white space, letters (all bytes beyond ASCII here), digits, others.
SPACE, LETTER, DIGIT, OTHER = range(4)
KINDS = np.full(256, OTHER, dtype=np.uint8)
KINDS[list(b" \t\n\v\f\r")] = SPACE
KINDS[list(range(97, 123)) + list(range(128, 256))] = LETTER
KINDS[list(b"0123456789")] = DIGIT
# Odd factors of a polynomial hash modulo 2**64 and random values of the bytes.
_RANDOM = np.random.default_rng(5)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_latin(text: bytes) -> bool:
    return b"<|" not in text and (text.isascii() and b"\x1c" not in text or LATIN.fullmatch(text.decode()) is not None)


def part(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-case bytes, as the tokenizer's pattern has them:
    's|'t|'re|'ve|'m|'ll|'d, runs of letters, single digits, runs of others."""
    kind = KINDS[text]
    before = np.empty_like(kind)
    before[:1], before[1:] = SPACE, kind[:-1]
    start = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
    quotes = np.flatnonzero(start & (text == 39))
    if len(quotes):
        ahead = np.concatenate([text, np.zeros(3, np.uint8)])
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        pair = one.astype(np.int32) * 256 + two
        short = np.isin(one, list(b"stmd"))
        long = np.isin(pair, [ord(w[0]) * 256 + ord(w[1]) for w in ("re", "ve", "ll")])
        start[quotes[short | long] + 1] = False
        for which, size in ((short, 2), (long & ~short, 3)):
            after = quotes[which] + size
            after = after[after < len(text)]
            start[after[kind[after] == LETTER]] = True
    starts = np.flatnonzero(start)
    breaks = np.flatnonzero(start | (kind == SPACE))
    ends = np.append(breaks, len(text))[np.searchsorted(breaks, starts, side="right")]
    return starts, ends


def _powers(factor: int, n: int) -> np.ndarray:
    powers = np.full(n, factor, dtype=np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


@functools.lru_cache(maxsize=2)
def _powers_of(bits: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_FACTOR, 1 << bits), _powers(_INVERSE, 1 << bits)


def hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    n = len(text) + 1
    powers, back = _powers_of(n.bit_length())
    sums = np.zeros(n, dtype=np.uint64)
    np.cumsum(_VALUES[text] * powers[: n - 1], out=sums[1:])
    return (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value first stands, and the number among these of every value."""
    which = pa.array(values).dictionary_encode().indices.to_numpy()
    most = np.maximum.accumulate(which)
    return np.flatnonzero(np.diff(most, prepend=np.int32(-1))), which


def heads(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as a number."""
    at = np.arange(8)
    held = at < (ends - starts)[:, None]
    return np.where(held, text[np.minimum(starts[:, None] + at, len(text) - 1)], np.uint8(0)).view(np.uint64).reshape(-1)


def blocks(text: bytes) -> list[bytes]:
    """``text`` cut at white space into parts of BLOCK bytes or so."""
    parts, at = [], 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(c, at + 1, at + BLOCK) for c in (b" ", b"\n"))
        if cut < 0:
            cut = min((x for x in (text.find(c, at + BLOCK) for c in (b" ", b"\n")) if x >= 0), default=len(text))
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


@dataclass
class Parted:
    """Texts as words: ``which`` is the number of each word in a row among the distinct ones, ``ends`` where each text's words end.

    The distinct words are the ``pieces``, or stand in ``latin`` (lower-case bytes) from ``starts`` to ``stops``, with their
    ``hashes``; those the tokenizer does not part further. ``open``: the only text goes on in the next group.
    """

    which: np.ndarray
    ends: np.ndarray
    open: bool = False
    pieces: list[bytes] | None = None
    latin: bytes | None = None
    starts: np.ndarray | None = None
    stops: np.ndarray | None = None
    hashes: np.ndarray | None = None

    @property
    def words(self) -> list[bytes]:
        return self.cut(slice(None)) if self.pieces is None else self.pieces

    def cut(self, some) -> list[bytes]:
        """The words of ``latin`` that have the numbers ``some``."""
        return [self.latin[a:b] for a, b in zip(self.starts[some].tolist(), self.stops[some].tolist(), strict=True)]


def _latin(texts: list[bytes], more: bool = False) -> Parted:
    joined = b"\n".join(texts).lower()
    text = np.frombuffer(joined, dtype=np.uint8)
    starts, ends = part(text)
    hashed = hashes(text, starts, ends)
    first, which = distinct(hashed)
    ends_of = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return Parted(which, ends_of, more, None, joined, starts[first], ends[first], hashed[first])


def _other(text: bytes, more: bool) -> Parted:
    pieces = text.split()
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(p, len(number)) for p in pieces], dtype=np.int64)
    return Parted(which, np.array([len(pieces)]), more, list(number))


def parted(texts: list[bytes]) -> Iterator[Parted]:
    """The texts (UTF-8) in groups of BLOCK bytes or so, in their order."""
    waiting, size = [], 0
    for text in texts:
        if len(text) <= BLOCK and is_latin(text):
            waiting.append(text)
            size += len(text)
            if size >= BLOCK:
                yield _latin(waiting)
                waiting, size = [], 0
            continue
        if waiting:
            yield _latin(waiting)
            waiting, size = [], 0
        parts = blocks(text)
        for k, p in enumerate(parts):
            more = k < len(parts) - 1
            yield _latin([p], more) if is_latin(p) else _other(p, more)
    if waiting:
        yield _latin(waiting)


class WordEncoder:
    """Ids of texts given as UTF-8."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.ends = np.zeros(size, dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}
        # The words of Latin letters: hash, first bytes, number of ids (0: none here) and ids of the one in each slot.
        self.hashes, self.heads = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.uint64)
        self.sizes, self.ids = np.zeros(1 << SLOTS, np.uint8), np.zeros((1 << SLOTS, WIDEST), self.kind)
        self.shift = np.uint64(64 - SLOTS)

    def learn_latin(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each word's end."""
        found, stops, n = [], [], 0
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            # The fast way gives the same ids without their places in the text.
            (done,) = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
            ids = np.array(done.ids, dtype=self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer parts words in another way")
            found.append(ids)
            stops.append(ends + n)
            n += len(ids)
        return np.concatenate(found), np.concatenate(stops)

    def learn(self, words: list[bytes], latin: bool) -> list[bytes]:
        """The ids of each word."""
        if not latin:
            done = self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
            return [np.array(d.ids, dtype=self.kind).tobytes() for d in done]
        if not words:
            return []
        ids, stops = self.learn_latin(words)
        raw, ends = ids.tobytes(), (stops * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each of the distinct words has its own: from the cache where it has them."""
        known = self.known
        unknown = [w for w in words if w not in known]
        fresh = dict(zip(unknown, self.learn(unknown, False), strict=True))
        found = [known[w] if w in known else fresh[w] for w in words]
        if len(known) + len(fresh) > CACHED:
            known.clear()
        known.update((w, ids) for w, ids in fresh.items() if len(w) <= LONGEST)
        sizes = np.array([len(f) for f in found], dtype=np.int64) // self.width
        return np.frombuffer(b"".join(found), dtype=self.kind), np.cumsum(sizes) - sizes, sizes

    def look_up_latin(self, group: Parted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``look_up``, for the words of a group of Latin letters."""
        slot = (group.hashes * np.uint64(_FACTOR)) >> self.shift
        head = heads(np.frombuffer(group.latin, np.uint8), group.starts, group.stops)
        sizes = self.sizes[slot].astype(np.int64)
        sizes[(self.hashes[slot] != group.hashes) | (self.heads[slot] != head)] = 0
        unknown = np.flatnonzero(sizes == 0)
        rows = self.ids[slot]
        within = np.arange(WIDEST)
        more, begin, wide = np.zeros(0, self.kind), np.zeros(0, np.int64), unknown[:0]
        if len(unknown):
            more, stops = self.learn_latin(group.cut(unknown))
            made = np.diff(stops, prepend=0)
            begin = stops - made
            short = made <= WIDEST
            fits, held = unknown[short], within < made[short, None]
            rows[fits] = np.where(held, more[np.minimum(begin[short, None] + within, len(more) - 1)], 0)
            sizes[fits] = made[short]
            place = slot[fits]
            # Of several words for one slot the last stays, in all arrays.
            self.hashes[place], self.heads[place] = group.hashes[fits], head[fits]
            self.sizes[place], self.ids[place] = made[short], rows[fits]
            wide, begin, made = unknown[~short], begin[~short], made[~short]
        flat = rows[within < sizes[:, None]]
        starts = np.cumsum(sizes) - sizes
        if len(wide):
            starts[wide], sizes[wide] = begin + len(flat), made
            flat = np.concatenate([flat, more])
        return flat, starts, sizes

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        begun = []
        for group in parted(texts):
            flat, starts, sizes = self.look_up_latin(group) if group.pieces is None else self.look_up(group.pieces)
            counts = sizes[group.which]
            stops = np.cumsum(counts)
            shift = starts[group.which] - (stops - counts)
            ids = flat[np.arange(counts.sum()) + np.repeat(shift, counts)]
            ends = np.concatenate([[0], stops])[group.ends]
            if group.open:
                begun.append(ids)
            elif begun:
                yield np.concatenate([*begun, ids])
                begun = []
            else:
                yield from np.split(ids, ends[:-1])


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, which keeps it from task to task."""
    return WordEncoder(path)
