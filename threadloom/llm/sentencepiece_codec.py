"""SentencePiece models run by the tokenizers library.

The model file is read by a small reader of its protobuf fields. From these the normaliser,
the metaspace marker, the scores and the byte fallback are rebuilt: unigram models as a
Unigram model with their scores; BPE models as merges, each piece's possible halves ranked by
the piece's score. Texts are encoded in multithreaded batches, new words in rows. Parity with
the sentencepiece library is verified for every word that a worker meets for the first time,
and for every text that is encoded whole; the ids are always those of the rebuilt tokenizer,
and documents in which the two differ are marked.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded alike;
very long texts are encoded whole; an empty table gives an empty result; in encode(), columns
that clash with the new ones are replaced.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lean, text_of
from .wordwise import WordEncoder, in_rows

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
#: Characters of text encoded at once.
PART_CHARS = 1 << 18
#: Of what workers keep.
KIND = "sentencepiece"
#: Words that a worker remembers, some 200 bytes each.
MEMORY = 200_000


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> Model:
    """The parts of a model file that encoding needs (field numbers of sentencepiece_model.proto)."""
    with open(path, "rb") as f:
        data = f.read()
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.collapse_spaces, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first; halves of one piece from left to right."""
    known = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
    found = []
    for at, (piece, score, kind) in enumerate(model.pieces):
        if kind == NORMAL and len(piece) > 1:
            found += [(-score, at, i, (piece[:i], piece[i:])) for i in range(1, len(piece)) if piece[:i] in known and piece[i:] in known]
    return [pair for *_, pair in sorted(found)]


def build(model: Model, prefix: bool = True):
    """A tokenizers.Tokenizer that encodes and decodes as the model does. prefix: whether texts
    get the model's dummy prefix (else they are taken as parts of a text)."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"models of kind {model.kind} are not supported")
    own = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.collapse_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()] if prefix else []
    if prefix and model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    own.normalizer = normalizers.Sequence(steps)
    end = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    own.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    return own


class Codec:
    """Encoder and decoder of one model in one worker."""

    def __init__(self, path: str, threads: int):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        self.model, self.other, self.threads = read_model(path), sentencepiece.SentencePieceProcessor(model_file=path), threads
        self.full, self.part = build(self.model), build(self.model, False)
        inner = any(MARK in p.lstrip(MARK) for p, _, kind in self.model.pieces if kind == NORMAL)
        newline = any("\n" in p for p, _, kind in self.model.pieces if kind == NORMAL)
        self.wordwise = self.model.dummy_prefix and self.model.escape and not (self.model.charsmap or self.model.collapse_spaces or inner or newline) and self.model.byte_fallback
        self.differ: set[tuple[int, ...]] = set()
        special = [re.escape(p) for p, _, kind in self.model.pieces if kind == USER]
        self.words = WordEncoder(self._words, self._texts, False, "|".join([MARK, *special]), MEMORY)
        self.begins = np.array([p[:1] == MARK for p, *_ in self.model.pieces])
        self.lead = len(self.other.encode("\n"))
        self.bytes = np.array([kind == BYTE for *_, kind in self.model.pieces])
        self.spelled = {i: _spelled(p) for p, i in self.full.get_vocab().items()}
        self.differing_words: set[str] = set()

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, compared with sentencepiece's."""
        ids, sizes = in_rows(words, self._own, self.begins)
        theirs, their_sizes = in_rows(words, self._theirs, self.begins)
        if not (np.array_equal(sizes, their_sizes) and np.array_equal(ids, theirs)):
            cut = [np.split(x, np.cumsum(n)[:-1]) for x, n in ((ids, sizes), (theirs, their_sizes))]
            self.differing_words.update(w for w, a, b in zip(words, *cut) if not np.array_equal(a, b))
        return ids, sizes

    def _own(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.part.encode_batch_fast(parts, add_special_tokens=False)]

    def _theirs(self, parts: list[str]) -> list[list[int]]:
        """sentencepiece has every text start with a space, so parts without one, and a space
        alone, are given to it after a newline."""
        bare = [p[:1] != " " or p == " " for p in parts]
        found = self.other.encode(["\n" + p if b else p[1:] for p, b in zip(parts, bare)], num_threads=self.threads)
        return [f[self.lead :] if b else f for f, b in zip(found, bare)]

    def _texts(self, texts: list[str]) -> list[list[int]]:
        own = [e.ids for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.other.encode(texts, num_threads=self.threads)
        self.differing_words.update(t for t, a, b in zip(texts, own, theirs) if a != b)
        return own

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """All ids, how many each text has, and whether both libraries agree on it."""
        if self.wordwise:
            ids, sizes = self.words.encode(texts)
        else:
            found = self._texts(texts)
            ids, sizes = np.array([x for f in found for x in f], np.uint32), np.array([len(f) for f in found])
        odd = self.differing_words
        same = [not odd or (t not in odd and odd.isdisjoint(_cut(t))) for t in texts]
        return ids, sizes, same

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self._decoded(own) for own in ids]

    def _decoded(self, ids: list[int]) -> str:
        """The bytes of the pieces one after another, which is what the decoder makes of them; ids
        that the model lacks, and bytes that are no UTF-8, are left to the decoder itself."""
        try:
            raw = b"".join(map(self.spelled.__getitem__, ids))
            return (raw[1:] if self.model.dummy_prefix and raw[:1] == b" " else raw).decode()
        except (KeyError, UnicodeDecodeError):
            return self.full.decode(ids, skip_special_tokens=False)


def _spelled(piece: str) -> bytes:
    """What a piece stands for: a byte of byte fallback, or its text."""
    byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
    return bytes.fromhex(byte[1]) if byte else piece.replace(MARK, " ").encode()


def _cut(text: str) -> list[str]:
    words = text.replace("\n", " \n \x01").split(" ")
    return words


def codec(path: str, threads: int = 2) -> Codec:
    return kept((KIND, path, os.getpid()), lambda: Codec(path, threads))


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of some PART_CHARS of text: ids as Python numbers take many times their text.
    What Arrow has freed goes back to the system after each, as a worker outlives its stage."""
    for batch in batches:
        ends, at = np.cumsum(pc.utf8_length(batch.column(column)).to_numpy().astype(np.int64)), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_CHARS, "right")))
            yield batch.slice(at, end - at)
            pa.default_memory_pool().release_unused()
            at = end


def _digests(own: Codec, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Where each text's ids start (and the last ends); their number, how many are of byte fallback, and their crc32."""
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    fallback, raw = np.concatenate([[0], np.cumsum(own.bytes[ids])]), memoryview(ids.astype("<u4").tobytes())
    crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return edges, {"n_ids": pa.array(np.diff(edges)), "n_bytes": pa.array(np.diff(fallback[edges]).astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64())}


def encode(docs: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """docs without text, with ids, n_ids, n_bytes (ids of byte fallback), ids_crc32 and parity."""
    new = {"ids": "array<int>", "n_ids": "long", "n_bytes": "long", "ids_crc32": "long", "parity": "boolean"}
    stay = [c for c in docs.columns if c.lower() not in {*new, "text"}]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in stay), *(f"{k} {v}" for k, v in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "text_"):
            own = codec(path, threads)
            ids, sizes, same = own.encode(part.column("text_").to_pylist())
            edges, told = _digests(own, ids, sizes)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))
            columns = {c: part.column(c) for c in stay} | {"ids": lists} | told | {"parity": pa.array(same, pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select(*stay, text_of().alias("text_")).mapInArrow(lean(run, KIND), schema)


def decode(encoded: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """encoded (any columns and ids) with text."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(codec(path, threads).decode([list(map(int, x)) for x in ids]), dtype=object)

    return encoded.withColumn("text", run("ids"))


def round_trip(docs: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """doc_id, n_ids, n_bytes, ids_crc32, parity and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, "text"):
            own, texts = codec(path, threads), part.column("text").to_pylist()
            ids, sizes, same = own.encode(texts)
            edges, told = _digests(own, ids, sizes)
            back = own.decode([ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])])
            columns = {"doc_id": part.column("doc_id")} | told | {"parity": pa.array(same, pa.bool_()), "restored": pa.array([a == b for a, b in zip(texts, back)], pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(lean(run, KIND), "doc_id long, n_ids long, n_bytes long, ids_crc32 long, parity boolean, restored boolean")
