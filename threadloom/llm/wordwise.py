"""Encoding whole texts word by word, with a memory of words met before.

Encoders that first cut a text before each space never merge across that cut, so a text's
ids are its words' ids one after another. Texts are cut at single spaces and single newlines
only; a text in which white space meets white space, or has other white space, is encoded
whole. Words are told apart in Arrow (dictionary encoding), and only words that this worker
has not met go to the encoder.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks a word that no space precedes: the first of a text and of a line.
BARE = "\x01"
#: White space beside white space, and white space other than a space or a line's end.
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_OTHER = re.compile("[\x01\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words remembered, at most; beyond that the memory starts anew.
MEMORY = 600_000
#: Characters of text taken at once.
PART = 4 << 20
#: Words encoded in one go.
ROW = 64


class WordEncoder:
    """encode_words: words, each after a space unless it starts with BARE, to all their ids one
    after another and how many each word has. encode_texts: whole texts to lists of ids. first_bare: no space stands before a text.
    whole: pattern of texts that can't be cut into words. memory: words remembered, if not MEMORY."""

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], encode_texts: Callable[[list[str]], list[list[int]]], first_bare: bool, whole: str = "(?!)", memory: int | None = None):
        self.encode_words, self.encode_texts, self.first_bare = encode_words, encode_texts, first_bare
        self.whole, self.memory = re.compile(whole), memory or MEMORY
        self._forget()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32 and how many each text has."""
        parts, sizes, first = [], [], 0
        while first < len(texts):
            end, room = first, PART
            while end < len(texts) and (end == first or room >= len(texts[end])):
                room -= len(texts[end])
                end += 1
            ids, n = self._part(texts[first:end])
            parts.append(ids)
            sizes.append(n)
            first = end
        return (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spaced = not self.first_bare  # then a text's own first space is beside another
        odd = [i for i, t in enumerate(texts) if (spaced and t[:1] == " ") or any(p in t for p in _PAIRS) or _OTHER.search(t) or self.whole.search(t)]
        marked = texts if not odd else list(texts)
        for i in odd:
            marked[i] = ""
        start = BARE if self.first_bare else ""
        words = pc.split_pattern(pa.array([start + t.replace("\n", " \n \x01") if t else BARE for t in marked], pa.large_string()), " ")
        flat = words.flatten().dictionary_encode()
        at = self._words(flat.dictionary.to_numpy(zero_copy_only=False).tolist())[flat.indices.to_numpy()]
        n = self.sizes.take(at)
        ends = np.cumsum(n)
        place = np.repeat(self.starts.take(at) - ends + n, n)
        place += np.arange(len(place))
        out = self.pool.take(place)
        edges = np.concatenate([[0], ends])[np.asarray(words.offsets) - np.asarray(words.offsets)[0]]
        sizes = np.diff(edges)
        if odd:
            pieces = np.split(out, edges[1:-1])
            for i, found in zip(odd, self.encode_texts([texts[i] for i in odd])):
                pieces[i], sizes[i] = np.array(found, np.uint32), len(found)
            out = np.concatenate(pieces)
        return out, sizes

    def _words(self, words: list[str]) -> np.ndarray:
        """Places of the (distinct) words' ids in starts and sizes; what is new is encoded and remembered."""
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        new = [words[i] for i in np.flatnonzero(at < 0).tolist()]
        if len(self.places) + len(new) > self.memory:
            self._forget()
            new, at = words, np.full(len(words), -1)
        if new:
            at[at < 0] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            ids, sizes = self.encode_words(new)
            ends = len(self.pool) + np.cumsum(sizes)
            self.places.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.pool = np.concatenate([self.pool, ids])
            self.starts, self.sizes = np.concatenate([self.starts, ends - sizes]), np.concatenate([self.sizes, sizes])
        return at

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.starts = self.sizes = np.zeros(0, np.int64)


def flattened(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as encode_words gives them."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


def in_rows(words: list[str], texts: Callable[[list[str]], list[list[int]]], begins: np.ndarray, simple: re.Pattern | None = None, quick: Callable[[list[str]], list[list[int]]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words after a space go to texts in rows of ROW, half the work of one by one; an id of
    begins (those that start with a space) within a row is where a word's first id is. Rows in
    which that does not tell the words apart, and other words, are encoded one by one. Rows of
    simple words alone (whole matches of that pattern) go to quick, which encodes them as texts would."""
    told = list(map(simple.fullmatch, words)) if simple else [None] * len(words)
    light = [i for i, m in enumerate(told) if m]
    plain = [i for i, (m, w) in enumerate(zip(told, words)) if not m and w and w[0] != BARE and w != "\n"]
    rows = [few[at : at + ROW] for few in (light, plain) for at in range(0, len(few), ROW)]
    spelled, n = [" " + " ".join([words[i] for i in row]) for row in rows], -(-len(light) // ROW)
    ids, sizes = flattened([*(quick(spelled[:n]) if n else []), *texts(spelled[n:])])
    starts, edges = np.flatnonzero(begins[ids]), np.concatenate([[0], np.cumsum(sizes)])
    row_of = np.searchsorted(edges, starts, "right") - 1
    told = np.bincount(row_of, minlength=len(rows)) == np.fromiter(map(len, rows), np.int64, len(rows))
    own = (np.minimum(np.append(starts[1:], len(ids)), edges[row_of + 1]) - starts)[told[row_of]]
    place = np.array([i for row, t in zip(rows, told.tolist()) if t for i in row], np.int64)
    known = np.zeros(len(words), bool)
    known[place] = True
    rest = np.flatnonzero(~known)
    each = flattened(texts([w[1:] if w[:1] == BARE else w if w == "\n" else f" {w}" for w in (words[i] for i in rest.tolist())]))
    first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    first[place], size[place] = starts[told[row_of]], own
    first[rest], size[rest] = len(ids) + np.cumsum(each[1]) - each[1], each[1]
    ends = np.cumsum(size)
    return np.concatenate([ids, each[0]])[np.repeat(first - (ends - size), size) + np.arange(int(size.sum()))], size
