import random

from threadloom.llm import sentence_spans as ss


def brute(rows):
    seen, hits = {}, {}
    for doc, text in sorted(rows):
        found = ss.sentences(text)
        for i, n in ss.spans(found):
            key = tuple(w for s in found[i : i + n] for w in s[2].split())
            if key in seen:
                hits.setdefault(doc, set()).update(range(i, i + n))
            else:
                seen[key] = doc
    return {doc: ss._without(text, hits.get(doc, set())) for doc, text in rows}


def test_corpus(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in ss.clean(docs).collect()}
    assert {i: r.text for i, r in got.items()} == brute(rows)
    assert any(r.n_removed for r in got.values())
    assert all(r.text == dict(rows)[i] for i, r in got.items() if not r.n_removed)


def test_sentences():
    text = "One two. Three? four!!\nFive six\n\n. 1.5 is it."
    assert [(text[a:b], n) for a, b, _, n in ss.sentences(text)] == [("One two.", 2), ("Three?", 1), ("four!!", 1), ("Five six", 2), (".", 1), ("1.5 is it.", 3)]


def test_a_lone_sentence_is_no_span(spark):
    lone = " ".join(f"w{i}" for i in range(35)) + "."
    docs = spark.createDataFrame([(1, f"Own start. {lone} Own end."), (2, f"Other. {lone} Another.")], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in ss.clean(docs).collect())
    long = " ".join(f"w{i}" for i in range(120))
    assert [s[3] for s in ss.sentences(long)] == [50, 50, 20] and "".join(long[a:b] for a, b, _, _ in ss.sentences(long)) == long


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(55)) + "."
    rows = [(1, "Own start. " + passage + " Own end.", "e"), (2, "Other start.\n" + passage + "\nOther end.", "e"), (3, None, None), (4, "", None), (5, "Short. Short. Short. Short. Short.", "e"), (6, passage + " " + passage, "e"), (None, passage, "e"), (2, "Other start.\n" + passage + "\nOther end.", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    out = ss.clean(docs.withColumnRenamed("removed", "extra"))
    got = sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in out.collect())
    two = (2, "Other start.\nOther end.", 2)  # 55 words without an end count as two sentences
    assert got == [(0, passage, 0), (1, "Own start. Own end.", 2), two, two, (3, "", 0), (4, "", 0), (5, rows[4][1], 0), (6, "", 4)]
    assert ss.clean(docs.drop("removed").limit(0)).count() == 0


def listed(words):
    """Every run, kept by the rule alone: first sentence and number of sentences."""
    runs = {(i, j - i): sum(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
    long = {(i, n) for (i, n), w in runs.items() if w >= 30 and n > 1}
    shortest = {(i, n) for i, n in long if (i, n - 1) not in long or (i + 1, n - 1) not in long}
    return sorted(shortest | {(i, n) for (i, n), w in runs.items() if n == 3 and w >= 20})


def test_spans_are_every_run():
    rng = random.Random(5)
    for words in [[35, 10, 12], [9, 24, 13, 7], [40], [29], [], *([rng.randint(1, 40) for _ in range(rng.randint(0, 12))] for _ in range(2000))]:
        assert ss.spans([(0, 0, "", n) for n in words]) == listed(words)


def test_whole_passages_go(spark):
    rng, rows, own = random.Random(6), [], []
    for k in range(60):
        sizes = [[35, 10, 12], [9, 24, 13, 7], [24, 15, 8, 4, 4]][k] if k < 3 else []
        while not sizes or k >= 3 and sum(sizes) <= 50:
            sizes.append(rng.randint(4, 24))
        passage = " ".join(" ".join(f"p{k}x{i}x{w}" for w in range(n)) + "." for i, n in enumerate(sizes))
        rows += [(2 * k, f"Start {k} a. {passage} End {k} a."), (2 * k + 1, f"Start {k} b. {passage} End {k} b.")]
        own += [rows[-2], (2 * k + 1, f"Start {k} b. End {k} b.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in ss.clean(docs).collect()) == own


def test_short_runs_are_a_parameter(spark):
    run = "Red one. Blue two. Green three."  # 6 words
    docs = spark.createDataFrame([(1, f"Alpha begins here. {run} Beta."), (2, f"Gamma begins there. {run} Delta.")], "doc_id long, text string")
    assert [r.n_removed for r in ss.clean(docs).orderBy("doc_id").collect()] == [0, 0]
    assert [r.text for r in ss.clean(docs, least_words=0).orderBy("doc_id").collect()] == [f"Alpha begins here. {run} Beta.", "Gamma begins there. Delta."]


def test_own_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "One. Two.", 7, "kept")], "doc_id long, text string, N_Removed int, key string")
    got = ss.clean(docs)
    assert got.columns == ["doc_id", "text", "key", "n_sentences", "n_removed", "first_ids"]
    assert [tuple(r) for r in got.collect()] == [(1, "One. Two.", "kept", 2, 0, [])]


def sentences_plainly(text):
    """(words, end) of every sentence: line by line, a sentence ends after a run of . ! ? before white space or the line's end, or
    after fifty words."""
    out, at = [], 0
    for line in text.split("\n"):
        start = 0
        for i, c in enumerate(line):
            if i + 1 == len(line) or c in ".!?" and line[i + 1].isspace():
                words = line[start : i + 1].split()
                while len(words) > 50:  # the end of the fiftieth word
                    end = start
                    for w in words[:50]:
                        end = line.index(w, end) + len(w)
                    out.append((words[:50], at + end))
                    start, words = end, words[50:]
                if words:
                    out.append((words, at + i + 1))
                start = i + 1
        at += len(line) + 1
    return out


def test_corpus_by_plain_rules(spark, sf_tiny):
    """Against every run of sentences, listed and compared without the operator's own functions."""
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    seen, want = {}, {}
    for doc, text in rows:
        found, gone = sentences_plainly(text), set()
        for i, n in listed([len(w) for w, _ in found]):
            key = tuple(x for w, _ in found[i : i + n] for x in w)
            if seen.setdefault(key, (doc, i)) != (doc, i):
                gone.update(range(i, i + n))
        kept, at = [], 0
        for i, (_, end) in enumerate(found):
            kept += [text[at:end]] if i not in gone else []
            at = end
        want[doc] = ("".join([*kept, text[at:]]).strip() if gone else text, len(gone))
    assert {r.doc_id: (r.text or "", r.n_removed) for r in ss.clean(docs).collect()} == want
    assert any(n for _, n in want.values())
