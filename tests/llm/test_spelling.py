import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import spelling

SCHEMA = "doc_id long, text string"
_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    count = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] = count.get(run, 0) + 1
    count = {w: n for w, n in count.items() if n >= 2}
    cuts = {}
    for w in count:
        for i in range(len(w)):
            cuts.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in count}
    for (_, rest), group in cuts.items():
        for w in group:
            near[w] |= group - {w}
            if rest in count:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return sorted(out, key=str)


def run(frame):
    return sorted((tuple(r) for r in spelling.variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def check(spark, rows):
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_corpus(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = run(docs)
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert any(r[1] for r in got)


def test_chains_ties_and_runs_of_equal_letters(spark):
    many = lambda w, n: " ".join([w] * n)
    rows = [(i, t) for i, t in enumerate([many("colours", 2), many("coloour", 30), many("colour", 9), many("colouur", 300), many("coolouur", 25), many("Colouurs", 2), many("aaaaaaa", 4), many("aaaaaaaa", 50), many("aaaaaaab", 50), many("aaaaaaac", 50)])]
    check(spark, rows)
    assert {r[0]: r[1] for r in brute(rows)}["aaaaaaa"] == "aaaaaaaa"


def test_long_words_and_odd_rows(spark):
    base = "acgt" * 16
    rows = [(None, None), (1, ""), (2, "× ÷ ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ àéîõüßÿ àéîõüßÿ"), (None, "NULLWORD nullword"), (None, "NULLWORD nullword")]
    for k, w in enumerate([base[:63], base[:63] + "x", base, base + "a", base + "b", base[:30] + "q" + base[30:], "z" * 5000, "z" * 5001, "z" * 4999 + "y"]):
        rows += [(100 + k, w)] * (2 if k % 2 else 40)
    check(spark, rows)


def test_empty_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "sentence sentence", "x", 5), (1, "sentence sentence", "x", 5)], "doc_id long, text string, word string, n int")
    assert run(frame) == brute([(1, "sentence sentence")] * 2)
    assert run(frame.limit(0)) == []


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.text("abA ß", min_size=7, max_size=60)), min_size=20, max_size=60))
def test_random_words(spark, rows):
    check(spark, rows + rows)
