import re

import numpy as np
import pytest

from threadloom.llm import mixing


def brute_targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_corpus(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    rows = mixing.mixture(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = {}
    for r in texts.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id].text or ""))
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] for s in sizes)
    again = {(r.doc_id, r.taken) for r in mixing.mixture(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in mixed.collect()) == sorted((r.doc_id, texts[r.doc_id].text) for r in rows for _ in range(r.copies))


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, size long, n long"
    rows = [(1, None, "x", "a", 7, 1), (2, "", "x", "a", 7, 1), (3, "w " * 4000, "x", "a", 7, 1), (None, "b c", "x", None, 7, 1), *[(4, "r s t", "x", "b", 7, 1)] * 7, (4, "r s u", "x", "b", 7, 1), (5, "q", None, "c", None, None), (6, " ", None, "empty", None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 3 * r.size for r in got)
    assert [r.target for r in got if r.source == "empty"] == [0.0]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mixture(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, psi = rng.integers(1, 1000, 500), rng.random(500)
    after = mixing.fly(size, psi, np.random.default_rng(2), False)
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert after.sum() == pytest.approx(psi.sum()) and (after * size).sum() == pytest.approx((psi * size).sum())
    landed = mixing.fly(size, psi, np.random.default_rng(2), True)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (psi * size).sum()) <= 1000


def test_flight_is_unbiased():
    size, psi = np.array([3, 5, 8, 13, 21, 3, 3]), np.array([0.3, 0.6, 0.5, 0.2, 0.4, 0.7, 0.3])
    mean = np.mean([mixing.fly(size, psi, np.random.default_rng(i), False) for i in range(4000)], 0)
    assert np.abs(mean - psi).max() < 0.03


def test_landing_against_all_outcomes():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 12):
        size, psi = rng.integers(1, 3000, n), rng.random(n) * 0.9 + 0.05
        got = mixing.landing(size, psi)
        outcomes = [[i >> j & 1 for j in range(n)] for i in range(1 << n)]
        near = [o for o in outcomes if abs(sum(o) - psi.sum()) <= 1]
        best = min(abs(float(np.dot(o, size) - np.dot(psi, size))) for o in near)
        assert abs(got.sum() - psi.sum()) <= 1 and abs(float(got @ size - psi @ size)) == pytest.approx(best)


def test_landing_of_many_documents_hits_the_words():
    rng = np.random.default_rng(4)
    for seed in range(20):
        size = np.sort(np.exp(rng.normal(5, 1.3, 300)).astype(int) + 1)[::-1]
        size = size[mixing.last_spread(size)]
        psi = np.full(300, 0.4)
        left = mixing.fly(size, psi, np.random.default_rng(seed), False, mixing.LANDING)
        assert ((left > 0) & (left < 1)).sum() <= mixing.LANDING
        got = mixing.fly(size, psi, np.random.default_rng(seed), True, mixing.LANDING)
        assert set(got) <= {0.0, 1.0} and abs(got.sum() - 120) <= 1 + 1e-6
        assert abs((got * size).sum() - 0.4 * size.sum()) <= 0.01 * 0.4 * size.sum()
    assert sorted(mixing.last_spread(np.full(7, 3))) == list(range(7)) and len(mixing.last_spread(np.zeros(0, int))) == 0
