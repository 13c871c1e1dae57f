import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadloom.llm import token_planes as tp

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["byte", "bit"]))
def test_planes_round_trip(ids, unit):
    ids = np.array(ids, np.uint32)
    assert (tp.from_planes(tp.to_planes(ids, unit), len(ids), unit) == ids).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=50), max_size=6))
def test_crc_joined(parts):
    assert tp.crc_joined([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB'sé1., \n\t 日!", max_size=30), max_size=4))
def test_words_as_whole_texts(texts):
    own = Tokenizer.from_file(PATH)
    ids, sizes = tp.byte_bpe_encoder(PATH).encode(texts)
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("unit,block", [("byte", 1 << 16), ("bit", 1000)])
def test_corpus(spark, sf_tiny, tmp_path, unit, block):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").repartition(3)
    extra = spark.createDataFrame([(-5, None), (-4, ""), (-4, "a <|endoftext|> b"), (-3, " x  y\n\n"), (10**9, "z " * 5000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra)
    path = f"file://{tmp_path}/planes"
    tp.write_corpus(docs, path, PATH, unit, block)
    own, at = Tokenizer.from_file(PATH), 0
    want = []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = sorted(tuple(r) for r in tp.corpus_digest(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert [g for g in got if g[0] != -4] == [w[:4] for w in want if w[0] != -4]
    assert sorted(g[2:] for g in got if g[0] == -4) == sorted(w[2:4] for w in want if w[0] == -4)
    assert sorted((r.doc_id, list(r.ids)) for r in tp.read_documents(spark, path).collect()) == sorted((w[0], w[4]) for w in want)


def test_empty(spark, sf_tiny, tmp_path):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").limit(0)
    tp.write_corpus(docs, f"file://{tmp_path}/none", PATH)
    assert tp.corpus_digest(spark, f"file://{tmp_path}/none").count() == 0


@functools.cache
def whole_texts():
    return Tokenizer.from_file(PATH)


WORDS = st.from_regex(r"[A-Za-zÀ-ÿ]{1,6}[!-/:-@\[-`{-~]{0,3}[a-zß×÷ªµ0-9']{0,2}", fullmatch=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=90).map(" ".join), max_size=4))
def test_words_that_are_cut_before_the_encoder(texts):
    own = whole_texts()
    ids, sizes = tp.byte_bpe_encoder(PATH).encode(texts)
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_usual_words_pass_by_the_pattern():
    """New words of letters and marks don't go through the pre-tokenizer's pattern, which takes half of
    the encoding; others do."""
    from threadloom.llm import wordwise

    given_to = {"quick": [], "texts": []}

    def taken(name):
        return lambda rows: given_to[name].extend(rows) or [[7] * len(r.split()) for r in rows]

    begins = np.arange(8) == 7
    ids, sizes = wordwise.in_rows(["Häuser,", "it's", "x1", "\x01first", "\n", "plain"], taken("texts"), begins, tp.SIMPLE, taken("quick"))
    assert given_to == {"quick": [" Häuser, plain"], "texts": [" it's x1", "first", "\n"]}
    assert sizes.tolist() == [1, 1, 1, 1, 0, 1] and ids.tolist() == [7] * 5


def test_letters_of_bytes():
    from tokenizers import pre_tokenizers

    assert set(map(chr, tp._byte_letters())) - {tp.SEP, "\n"} <= set(pre_tokenizers.ByteLevel.alphabet())
    assert "".join(map(chr, tp._byte_letters()[list(" é".encode())])) == "ĠÃ©"
