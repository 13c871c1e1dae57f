"""Ranked search: boolean clauses, phrases, stems, the stored indexes and their updates, substrings and snippets."""

import random
import time

import pytest
from pyspark.sql import functions as F

from threadloom.operators import index, matching, search, substrings

TEXTS = [
    "deploy to staging now", "deploy the service", "staging only", "a rolling deploy of the service to prod", "running tests runs the run", "Über den Wolken", "", None,
    "the quick brown fox jumps over the lazy dog", "quick the brown", "transaction log", "deploy deploy deploy", "prod service prod service",
]


def corpus(spark, texts=TEXTS):
    rows = [(i, f"s{i % 4}", "user", t, float(i), f"2024-01-0{1 + i % 5}T00:00:00Z", f"{i:08x}") for i, t in enumerate(texts)]
    sessions = spark.createDataFrame([(f"s{k}", False, 5, "p") for k in range(4)], "id string, is_subagent boolean, message_count int, project string")
    return spark.createDataFrame(rows, "id long, session_id string, role string, content string, ts double, ts_iso string, uuid string"), sessions


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def found(hits):
    out = {}
    for r in hits.collect():
        out.setdefault(r.query_id, set()).add(r.id)
    return out


@pytest.mark.parametrize("held", [True, False])
def test_boolean_queries(spark, held, monkeypatch):
    if not held:  # the same over tables that no plan holds
        monkeypatch.setattr(matching, "MOST_QUERIES", 0)
        monkeypatch.setattr(matching, "MOST_TERMS", 0)
    m, s = corpus(spark)
    q = asked(spark, "deploy && !staging", "deploy NOT staging", "deploy && staging", "staging || prod && !rolling", "!deploy", '"the service" && deploy', "deploy NOT the service", "zzz && deploy", "ansac && !x", "deploy staging", "ansac", '"brown fox"', "service/to prod")
    want = {0: {1, 3, 11}, 1: {1, 3, 11}, 2: {0}, 3: {0, 2, 12}, 5: {1, 3}, 6: {0, 11}, 9: {0, 1, 2, 3, 11}, 10: {10}, 11: {8}, 12: {3, 12}}
    got = search.keyword_search(m, s, q, limit=20)
    assert found(got) == want
    assert all(r.coverage == 1 for r in got.collect() if r.query_id in (0, 1, 2, 3, 5, 6))
    plain = search.keyword_search(m, s, q, limit=20, sort="newest").where("query_id = 9").orderBy("rank")
    assert [r.id for r in plain.collect()] == [11, 3, 2, 1, 0]


def test_fetch_factors_and_tools(spark):
    m, s = corpus(spark, [f"alpha beta {i}" for i in range(60)] + ["gamma [TOOL:sh] delta"])
    q = asked(spark, "alpha", "alpha beta", "delta")
    ranks = {r.query_id: r.n for r in search.keyword_search(m, s, q, limit=3).groupBy("query_id").agg(F.max("bm25_rank").alias("n")).collect()}
    assert ranks == {0: 3, 1: 3}  # the term within the tool run is not shown
    assert found(search.keyword_search(m, s, q, limit=3, tools=True))[2] == {60}


def test_stems(spark, tmp_path):
    m, s = corpus(spark)
    stemmed = index.write_index(m, f"file://{tmp_path}/i", stem="porter")
    q = asked(spark, "run", "services && deployed", '"running test"')
    assert found(search.matches(stemmed, q)) == {0: {4}, 1: {1, 3}, 2: {4}}
    assert found(search.matches(index.write_index(m, f"file://{tmp_path}/j"), q)) == {0: {4}}


def postings(ix):
    return sorted((r.term, r.id, r.len, r.tf, tuple(r.positions)) for r in ix.postings.collect())


def same(a, b):
    assert postings(a) == postings(b)
    assert sorted((r.term, r.df) for r in a.terms.collect()) == sorted((r.term, r.df) for r in b.terms.collect())
    x, y = a.totals.first(), b.totals.first()
    assert x.n_docs == y.n_docs and (x.avg_len == y.avg_len or abs(x.avg_len - y.avg_len) < 1e-9)


def test_index_updates_equal_a_fresh_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FOLD", 3)
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta".split()
    held = {i: " ".join(rng.choices(words, k=rng.randint(0, 6))) for i in range(30)}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "id long, content string")
    path = f"file://{tmp_path}/i"
    index.write_index(frame(held), path)
    for step in range(5):
        before = index.open_index(spark, path)
        kept = postings(before)
        changed = {rng.randint(0, 40): " ".join(rng.choices(words, k=3)) for _ in range(4)}
        removed = [] if step == 0 else [(rng.randint(0, 30),)]
        removed = [r for r in removed if r[0] not in changed]
        index.update_index(spark, path, frame(changed), spark.createDataFrame(removed, "id long") if removed else None)
        held = {k: v for k, v in (held | changed).items() if (k,) not in removed}
        same(index.open_index(spark, path), index.write_index(frame(held), f"file://{tmp_path}/fresh{step}"))
        assert postings(before) == kept  # a reader keeps what it opened


def test_a_failed_update_leaves_the_old_state(spark, tmp_path, monkeypatch):
    m, _ = corpus(spark)
    path = f"file://{tmp_path}/i"
    old = index.write_index(m, path)
    monkeypatch.setattr(index, "_save_manifest", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        index.update_index(spark, path, m.where("id = 1").withColumn("content", F.lit("changed")))
    same(index.open_index(spark, path), old)


def test_substrings(spark, tmp_path):
    m, _ = corpus(spark)
    grams = substrings.write_gram_index(m, f"file://{tmp_path}/g")
    probes = spark.createDataFrame([(0, "ansac"), (1, "rolling deploy"), (2, "übe"), (3, "nothere"), (4, "the")], "query_id int, probe string")
    want = {q: {i for i, t in enumerate(TEXTS) if t and p in t.lower()} for q, p in ((r.query_id, r.probe) for r in probes.collect())}
    want = {q: ids for q, ids in want.items() if ids}
    assert found(substrings.substring_search(m, probes)) == want == found(substrings.substring_search(m, probes, index=grams))


def test_work_grows_with_the_text_alone(spark):
    """A text of 1 MB, four times one of 256 KB."""
    took = {}
    terms = spark.createDataFrame([(1, "needle")], "query_id int, term string")
    for words in (40_000, 160_000):
        text = " ".join(f"word{i % 997}" for i in range(words)) + " Needle end"
        docs = spark.createDataFrame([(1, text)], "id long, content string")
        hit = spark.createDataFrame([(1, 1)], "query_id int, id long")
        for _ in range(2):
            start = time.time()
            got = search.token_snippet(hit, docs, terms).first().snippet
            assert got.endswith(">>>Needle<<< end") and got.startswith("…")
            assert found(substrings.substring_search(docs, spark.createDataFrame([(1, "eedle e")], "query_id int, probe string"))) == {1: {1}}
            took[words] = time.time() - start
    assert took[160_000] < 4 * took[40_000] + 3


def test_many_phrases_are_met_by_runs_of_words(spark, tmp_path, monkeypatch, capfd):
    """Phrases that share a word, each asked often: the texts' places are not repeated for each
    phrase, and equal queries are answered once."""
    monkeypatch.setattr(matching, "MOST_QUERIES", 0)
    monkeypatch.setattr(matching, "MOST_TERMS", 0)
    rng = random.Random(7)
    texts = {i: " ".join(rng.choices("a b c the d".split(), k=12)) for i in range(40)}
    m = spark.createDataFrame(list(texts.items()), "id long, content string")
    phrases = ["the a", "the b", "the the", "a b c", "the", "b the d a", "zzz the"]
    q = spark.createDataFrame([(n, f'"{phrases[n % 7]}"') for n in range(70)], "query_id int, text string")
    kept, write = {}, matching.written
    monkeypatch.setattr(matching, "written", lambda frame, name: kept.setdefault(name, write(frame, name)))
    got = found(search.matches(index.write_index(m, f"file://{tmp_path}/i"), q))
    want = {n: {i for i, t in texts.items() if f" {phrases[n % 7]} " in f" {t} "} for n in range(70)}
    assert got == {n: ids for n, ids in want.items() if ids}
    assert kept["hits"].count() == sum(len(want[n]) for n in range(7))
    matching.item_hits(index.open_index(spark, f"file://{tmp_path}/i"), matching.with_items(spark.createDataFrame([(p,) for p in phrases], "term string"))).explain()
    assert "explode(positions" not in capfd.readouterr().out


def test_many_probes_meet_texts_in_one_pass(spark, monkeypatch):
    """Repeated, short, long and absent probes, in blocks."""
    rng = random.Random(3)
    texts = {i: "".join(rng.choices("abC é", k=60)) for i in range(30)} | {30: None, 31: ""}
    docs = spark.createDataFrame(list(texts.items()), "id long, content string")
    probes = [(texts[i] or "").lower()[5 : 5 + n] for i in range(30) for n in (2, 3, 4, 9, 20)] + ["zzz", "abc"]
    asked = spark.createDataFrame([(q, p) for q, p in enumerate(probes * 3)] + [(999, None)], "query_id int, probe string")
    found_of, pairs = substrings._met, []
    monkeypatch.setattr(substrings, "_met", lambda *a: pairs.append(found_of(*a)) or pairs[-1])
    monkeypatch.setattr(substrings, "MOST_PROBES", 5)
    monkeypatch.setattr(substrings, "BLOCK", 40)
    got = found(substrings.substring_search(docs, asked))
    want = {q: {i for i, t in texts.items() if t and p in t.lower()} for q, p in enumerate(probes * 3) if len(p) >= 3}
    assert got == {q: ids for q, ids in want.items() if ids}
    once = {p: want[q] for q, p in enumerate(probes) if len(p) >= 3}
    assert len(pairs) > 1 and sum(d.count() for d in pairs) == sum(map(len, once.values()))
