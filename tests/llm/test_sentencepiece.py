import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import sentencepiece_codec as sc
from threadloom.llm import wordwise

PATH = public_tokenizers.path("piece_bpe_32k.model")
OTHER = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_model_is_read():
    model = sc.read_model(PATH)
    assert len(model.pieces) == OTHER.get_piece_size() == 32_000
    assert all(model.pieces[i][0] == OTHER.id_to_piece(i) for i in range(0, 32_000, 37))
    assert (model.kind, model.byte_fallback, model.dummy_prefix, model.collapse_spaces) == (sc.BPE, True, True, False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé1., \n\t 日▁!", max_size=25), max_size=4))
def test_same_ids_as_sentencepiece(texts):
    ids, sizes, _ = sc.codec(PATH).encode(texts)
    want = OTHER.encode(texts)
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_corpus(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in sc.round_trip(docs, PATH).collect():
        ids = OTHER.encode(texts[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.parity and r.restored
    encoded = sc.encode(docs, PATH)
    assert {r.doc_id: r.text for r in sc.decode(encoded, PATH).collect()} == texts


def test_whole_texts_by_the_tokenizers_library():
    own = sc.build(sc.read_model(PATH))
    for text in ("Hello world", " two  spaces", "line\nbreak", "日本語 and é", "a" * 500):
        assert own.encode(text, add_special_tokens=False).ids == OTHER.encode(text)
        assert own.decode(OTHER.encode(text)) == text


def test_unigram_model():
    model = sc.Model([("<unk>", 0.0, sc.UNKNOWN), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1), ("a", -4.0, 1)], sc.UNIGRAM)
    own = sc.build(model)
    assert own.encode(" a  b ", add_special_tokens=False).tokens == ["▁a", "▁", "b"]


def test_edges(spark):
    rows = [(1, None, "x", 1), (None, "", "y", None), (3, "a b", None, 2), (3, "a b", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n long")
    got = sc.encode(docs, PATH)
    assert got.columns == ["doc_id", "n", "ids", "n_ids", "n_bytes", "ids_crc32", "parity"]
    assert sorted((r.doc_id or 0, r.n or 0, r.n_ids) for r in got.collect()) == [(0, 0, 0), (1, 1, 0), (3, 2, 2), (3, 2, 2)]
    assert sc.encode(docs.limit(0), PATH).count() == 0


def test_parts_of_a_batch_are_small(monkeypatch):
    """A batch is taken in runs of PART_CHARS; of it no copy as Python texts is held, and what Arrow freed goes back after each."""
    freed = []
    monkeypatch.setattr(sc.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: freed.append(1)})())
    batch = sc.pa.RecordBatch.from_pydict({"n": [1, 2, 3, 4], "t": ["a" * sc.PART_CHARS, "", "b", "é" * (3 * sc.PART_CHARS)]})
    assert [p.column("n").to_pylist() for p in sc._parts(iter([batch, batch.slice(0, 0)]), "t")] == [[1, 2], [3], [4]]
    assert len(freed) == 3 and sc.PART_CHARS <= 1 << 18


class Counted:
    """A tokenizer that counts what it is given."""

    def __init__(self, own):
        self.own, self.given = own, 0

    def encode_batch_fast(self, texts, **options):
        self.given += len(texts)
        return self.own.encode_batch_fast(texts, **options)

    def decode(self, ids, **options):
        self.given += 1
        return self.own.decode(ids, **options)

    decode_batch = None


def test_new_words_go_in_rows_and_few_texts_to_the_decoder():
    """One by one, words took the tokenizers library most of op4's time, and its decoder the rest."""
    own = sc.Codec(PATH, 2)
    own.part, own.full = Counted(own.part), Counted(own.full)
    text = " ".join(f"w{i}é" for i in range(1_000)) + "\nnew line 日"
    ids, sizes, same = own.encode([text, ""])
    assert ids.tolist() == OTHER.encode(text) and sizes.tolist() == [len(ids), 0] and same == [True, True]
    assert own.part.given < 30
    assert own.decode([ids.tolist(), []]) == [text, ""] and own.full.given == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 32_010)), max_size=8), max_size=4))
def test_decodes_as_the_tokenizers_library(ids):
    """Any ids: control pieces, bytes that are no UTF-8, spaces at the start, and ids beyond the model."""
    assert sc.codec(PATH).decode(ids) == sc.codec(PATH).full.decode_batch(ids, skip_special_tokens=False)


def test_only_the_word_that_differs_is_marked():
    class Other:
        def encode(self, texts, **_):
            return [[7] + f[1:] if "odd" in t and f else f for t, f in zip(texts, OTHER.encode(texts))]

    own = sc.Codec(PATH, 2)
    own.other = Other()
    assert own.encode(["odd one", "other words", "one"])[2] == [False, True, True]
    assert own.differing_words == {"odd"}


def test_a_row_that_tells_no_words_apart_leaves_others_alone(monkeypatch):
    """Pieces without a leading space at the start of a row are no part of the row before it."""
    monkeypatch.setattr(wordwise, "ROW", 2)
    begins = np.array([True, False])
    ids, sizes = wordwise.in_rows(["a", "b", "xx", "c", "\x01d", "\n", ""], lambda many: [[0 if c == " " and t[i + 1 : i + 2] != "x" else 1 for i, c in enumerate(t)] for t in many], begins)
    assert sizes.tolist() == [2, 2, 3, 2, 1, 1, 1] and ids.tolist() == [0, 1, 0, 1, 1, 1, 1, 0, 1, 1, 1, 0]
