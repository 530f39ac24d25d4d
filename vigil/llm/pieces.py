"""Cutting text into a tokenizer's pieces, with repeated ones encoded once."""

from __future__ import annotations

import gc
import re
import string
from array import array
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Most pieces and chunks in one generation of a worker's caches; results do
#: not depend on them.
PIECES, CHUNKS = 1 << 19, 1 << 16
_MARKS = frozenset(".,;:!?")
_TAIL = "".join(c for c in string.punctuation if c != "'")  # no contraction starts with these
TOGETHER = 1 << 21  # characters of the texts that are cut together
SPACE_CUT_PATTERN = public_tokenizers.PATTERN
_BLANK_AFTER_SPACE = re.compile(r" (?=\s|\Z)").search


@cache
def other_classes() -> tuple[Callable, dict[int, str]]:
    """Code points whose class (letter, number, other) the reference engine and
    the two used here do not agree on, as their Unicode tables are of different
    age: a search for one of them, and for each a character that all engines
    put where the reference engine has the code point.

    Asked of the engine itself: with a vocabulary of single bytes and a class as
    its pattern, it encodes the characters of that class and drops the others."""
    import tiktoken
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    ask = {bytes([i]): i for i in range(256)}

    def theirs(of_class: str) -> set[str]:
        engine = tiktoken.Encoding("classes", pat_str=of_class, mergeable_ranks=ask, special_tokens={})
        return set(bytes(engine.encode_ordinary(every)).decode())

    letters, numbers = theirs(r"\p{L}"), theirs(r"\p{N}")
    odd = sorted(letters.symmetric_difference(filter(str.isalpha, every)) | letters.symmetric_difference(regex.findall(r"\p{L}", every))
                 | numbers.symmetric_difference(regex.findall(r"\p{N}", every)))
    stand_in = {ord(c): "a" if c in letters else "0" if c in numbers else "\u2022" for c in odd}
    if not odd:
        return (lambda text: None), stand_in
    first = re.compile(f"[^\0-{re.escape(chr(ord(odd[0]) - 1))}]").search  # most texts end here
    any_odd = re.compile(f"[{re.escape(''.join(odd))}]").search
    return (lambda text: first(text) and any_odd(text)), stand_in


class PieceEncoder:
    """Ids of texts whose pieces (the pattern's matches) are encoded apart.

    With the public byte-level pattern a piece always starts at a space that
    stands before a visible character, and what follows does not change the
    pieces before it: such texts are cut at spaces first, and the ids of
    whole chunks (a word with its punctuation) are looked up.  Texts with a
    code point of :func:`other_classes` are cut by stand-ins for those.  Each
    step of ``scale`` halves the caches.

    ``encode_pieces`` gives the ids of each of several pieces.  The new words
    of texts that are cut together come to it in code point order, unless
    ``_in_order`` is false."""

    _in_order = True  # whether new words come in code point order

    def __init__(self, pattern: str, encode_pieces: Callable[[Iterable[str]], Iterable[Iterable[int]]], scale: int = 0,
                 together: int = TOGETHER):
        self._together = together
        self._piece_limit, self._chunk_limit = PIECES >> scale, CHUNKS >> scale
        self._pattern = regex.compile(pattern)
        self._find = self._pattern.findall
        self._odd, self._stand_ins = other_classes()
        self._encode_pieces = encode_pieces
        self._cuts = pattern == SPACE_CUT_PATTERN
        # two generations of each cache: what is used moves to the young one; when
        # that is full it becomes the old one and the former old one is dropped
        self._pieces: dict[str, bytes] = {}
        self._old_pieces: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}  # of letters only, after a space
        self._old_words: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self._old_chunks: dict[str, bytes] = {}

    def _ids(self, pieces: Iterable[str]) -> Iterable[bytes]:
        return (array("i", x).tobytes() for x in self._encode_pieces(pieces))

    def _piece(self, p: str) -> bytes:
        got = self._pieces.get(p)
        if got is None:
            got = self._old_pieces.get(p)
            if got is None:
                got, = self._ids([p])
            if len(p) <= 64:
                if len(self._pieces) >= self._piece_limit:
                    self._old_pieces, self._pieces = self._pieces, {}
                self._pieces[p] = got
        return got

    def _chunk(self, text: str) -> bytes:
        if self._odd(text):
            return b"".join([self._piece(text[m.start():m.end()]) for m in self._pattern.finditer(text.translate(self._stand_ins))])
        return b"".join([self._piece(p) for p in self._find(text)])

    def _keep_word(self, w: str, ids: bytes) -> bytes:
        if len(w) <= 64:
            if len(self._words) >= self._piece_limit:
                self._old_words, self._words = self._words, {}
            self._words[w] = ids
        return ids

    def _learned(self, words: list[str]) -> list[bytes]:
        """Ids of the pieces " " + w; the words (of letters) that are not known are encoded together."""
        out = list(map(self._words.get, words))
        before, new = self._old_words.get, []
        for i in [i for i, x in enumerate(out) if x is None]:
            got = before(words[i])
            if got is None:
                new.append(i)
            else:
                out[i] = self._keep_word(words[i], got)
        if self._in_order:
            new.sort(key=words.__getitem__)
        found = [words[i] for i in new]
        ids = list(self._ids([" " + w for w in found]))
        for i, x in zip(new, ids):
            out[i] = x
        if len(self._words) + len(found) <= self._piece_limit:
            self._words.update((w, x) for w, x in zip(found, ids) if len(w) <= 64)
        else:
            for w, x in zip(found, ids):
                self._keep_word(w, x)
        return out

    def _letters(self, w: str) -> bytes:
        """Ids of the piece " " + w, w of letters."""
        got = self._words.get(w)
        if got is None:
            got = self._old_words.get(w)
            got = self._keep_word(w, next(iter(self._ids([" " + w]))) if got is None else got)
        return got

    def _word(self, p: str) -> bytes:
        """Ids of the chunk " " + p."""
        if p.isalpha():  # one piece
            return self._letters(p)
        if p[-1:] in _MARKS and p[:-1].isalpha():  # two
            return self._letters(p[:-1]) + self._piece(p[-1])
        got = self._chunks.get(p)
        if got is None:
            got = self._old_chunks.get(p)
            if got is None:
                got = self._lines(p)
            if len(p) <= 64:
                if len(self._chunks) >= self._chunk_limit:
                    self._old_chunks, self._chunks = self._chunks, {}
                self._chunks[p] = got
        return got

    def _lines(self, p: str) -> bytes:
        """Ids of the chunk " " + p; a line feed between visible characters is a piece."""
        a, feed, b = p.partition("\n")
        if feed and a and not a[-1].isspace() and b and not b[0].isspace():
            return self._word(a) + self._piece(feed) + (self._piece(b) if b.isalpha() else self._chunk(b))
        return self._chunk(" " + p)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text (int32).  Texts are cut into chunks together, so
        that a chunk is looked up once for all its places in them."""
        out: list[np.ndarray] = [None] * len(texts)
        together: list[int] = []
        chars = 0
        for i, text in enumerate(texts):
            if not self._cuts or _BLANK_AFTER_SPACE(text) or self._odd(text):
                out[i] = np.frombuffer(self._chunk(text), np.int32)
                continue
            together.append(i)
            chars += len(text)
            if chars >= self._together:
                self._encode_chunks(texts, together, out)
                together, chars = [], 0
        if together:
            self._encode_chunks(texts, together, out)
        return out

    def _encode_chunks(self, texts: Sequence[str], which: list[int], out: list[np.ndarray]) -> None:
        parts = pc.split_pattern(pa.array([texts[i] for i in which], pa.large_string()), " ")
        bounds = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        lists = self._words_ids(coded.dictionary)
        at = coded.indices.to_numpy().copy()
        at[bounds[:-1]] = len(lists) - 1  # a text's first chunk has no space before it
        placed = lists.take(pa.array(at))
        flat, ends = placed.values.to_numpy(), placed.offsets.to_numpy()[bounds]
        for i, a, b in zip(which, ends[:-1].tolist(), ends[1:].tolist()):
            first = np.frombuffer(self._chunk(texts[i].partition(" ")[0]), np.int32)
            out[i] = np.concatenate([first, flat[a:b]])

    def _words_ids(self, words: pa.Array) -> pa.Array:
        """Ids of the chunks " " + w, w distinct, and one more entry of no ids.
        Letters, with or without punctuation after them (a piece of its own),
        are looked up together."""
        stem = pc.ascii_rtrim(words, _TAIL)
        coded = stem.dictionary_encode()
        stems = _strings(coded.dictionary)
        head = coded.indices.to_numpy().copy()  # each word is two entries
        letters = [i for i, s in enumerate(stems) if s.isalpha()]
        entries = [b""] * (len(stems) + 1)
        for i, x in zip(letters, self._learned([stems[i] for i in letters])):
            entries[i] = x
        plain = np.zeros(len(stems), bool)
        plain[letters] = True
        plain, none = plain[head], len(stems)
        after = np.full(len(words) + 1, none)
        size = pc.binary_length(stem).to_numpy()
        tailed = np.flatnonzero(plain & (size < pc.binary_length(words).to_numpy()))
        tails = {}
        for i, n, w in zip(tailed.tolist(), pc.utf8_length(stem.take(pa.array(tailed))).to_numpy().tolist(), _strings(words.take(pa.array(tailed)))):
            tail = w[n:]
            if tail not in tails:
                tails[tail] = len(entries)
                entries.append(self._chunk(tail))
            after[i] = tails[tail]
        others = np.flatnonzero(~plain)
        head[others] = np.arange(len(entries), len(entries) + len(others))
        entries += [self._word(w) for w in _strings(words.take(pa.array(others)))]
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        start = np.cumsum(size) - size
        order = np.stack([np.append(head, none), after], 1).ravel()
        ends = np.cumsum(size[order])
        flat = np.frombuffer(b"".join(entries), np.int32)
        flat = flat[np.arange(ends[-1]) + np.repeat(start[order] - (ends - size[order]), size[order])]
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends[1::2]])), pa.array(flat))


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()  # without a scalar object for each


@contextmanager
def uncollected():
    """No garbage collection meanwhile: the caches only grow, and scanning
    their many small objects again and again would cost more than the work."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
