import zlib

import numpy as np
import pytest

from threadloom.llm import toxicity as T


@pytest.fixture(scope="module")
def small_scores(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r for r in T.toxicity(docs, labels).collect()}


def test_held_out_accuracy(small_scores):
    docs, labels, got = small_scores
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    told = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in told]) > 0.93 and sum(a and b for a, b in told) >= sum(b for _, b in told) / 2


def test_labels_of_held_out_rows_are_not_used(small_scores):
    docs, labels, got = small_scores
    turned = labels.withColumn("toxic", T.F.when(T.held_out(), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    again = {(r.doc_id, r.score) for r in T.toxicity(docs.withColumn("lang", T.F.lit("xx")).withColumn("source", T.F.lit("x")), turned).collect()}
    assert again == {(i, r.score) for i, r in got.items()}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (3, "w " * 70_000, None), (3, "w " * 70_000, None), (2, "x", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (3, 1), (2, 0)], "doc_id long, toxic int")
    for few in (labels, labels.limit(0), labels.where("toxic = 1")):
        rows = T.toxicity(docs, few).collect()
        assert len(rows) == 5 and len({r.score for r in rows if r.doc_id == 3}) == 1 and all(0 < r.score < 1 for r in rows)
    assert T.toxicity(docs.limit(0), labels).count() == 0


def plain(net, words):
    """The network by its definition, a window and a filter at a time."""
    vectors = [np.mean([net.table[r] for r in T.word_rows(w)], axis=0) for w in words]
    total = net.base
    if not words:
        return total
    for k, (f, b) in enumerate(zip(net.filters, net.offsets)):
        for j in range(f.shape[2]):
            best = max((b[j] + sum(vectors[t + i] @ f[i, :, j] for i in range(len(f)) if 0 <= t + i < len(words)) for t in range(1 - len(f), len(words))))
            total += max(best, 0) * net.out[k * f.shape[2] + j]
    return total


def test_scores_against_the_definition(monkeypatch):
    rng = np.random.default_rng(2)
    net = T.Network(rng.normal(size=(T.TABLE, T.DIM)), [rng.normal(size=(w, T.DIM, T.FILTERS)) for w in T.WIDTHS], [rng.normal(size=T.FILTERS) for _ in T.WIDTHS], rng.normal(size=len(T.WIDTHS) * T.FILTERS), 0.3)
    texts = [[f"w{x}" for x in rng.integers(0, 40, n)] for n in (0, 1, 2, 3, 50, 17, 0, 130)]
    want = [plain(net, t) for t in texts]
    for piece, cache in ((1 << 16, 400_000), (7, 400_000), (16, 20)):
        monkeypatch.setattr(T, "PIECE", piece)
        monkeypatch.setattr(T, "CACHE", cache)
        scorer = T.Scorer(net)
        for part in (slice(0, 5), slice(5, None), slice(0, None)):
            assert np.allclose(scorer.scores(texts[part])[0], want[part], atol=1e-3)


def test_stems_and_thresholds():
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("bal", "cor", "dim", "fep", "gol") for b in ("in", "or", "esk", "und")]
    texts, toxic = [], np.arange(600) % 5 == 0
    for t in toxic:
        text = list(rng.choice(words, 60))
        if t:
            for at in rng.integers(0, 60, 4):
                text[at] = "vilnak" + str(rng.choice(["in", "or", "esk", "und", "al", "et"]))
        texts.append(text)
    net = T.fit(T.Coded(texts[:500]), toxic[:500].astype(int))
    odds = T.Scorer(net).scores(texts[500:] + [["bal", "vilnakunseen", "cor"], ["bal", "cor"]])[0]
    cut = T.threshold(odds[:100], toxic[500:].astype(int))
    assert ((odds[:100] > cut) == toxic[500:]).all() and odds[100] > cut > odds[101]
    assert T.threshold(np.array([-3.0, -2.0, 4.0, 5.0]), np.array([0, 0, 1, 1])) == 1.0
    assert T.threshold(np.array([1.0, 2.0]), np.array([1, 1]), 0.7) == 0.7


def test_every_labelled_text_is_fitted(spark, monkeypatch):
    """Two clean texts each share a word of their own; each such word has its evidence, however the
    texts are partitioned and dealt, and repeated rows and labels count as often as they occur."""
    name = lambda i: "".join("bcdfghjklm"[int(d)] for d in f"{i:05d}")
    rows = [(i, f"and {name(i // 2)}" if i < 9000 else f"and vilnak {name(i)}") for i in range(9600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 9000)) for i, _ in rows], "doc_id long, toxic int")
    used = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(f"c{i}".encode()) % T.CALIBRATION}
    got = T.train(docs, labels)
    pairs = [i // 2 for i in range(0, 9000, 2) if i in used and i + 1 in used]
    told = np.array([got.table[zlib.crc32(f"{name(i)}$".encode()) % T.TABLE, 0] for i in pairs])
    assert len(pairs) > 1500 and (told < -0.1).mean() > 0.99
    monkeypatch.setattr(T, "SHARD", 1000)
    nets = [T.train(docs.repartition(n), labels) for n in (1, 5)]
    assert (nets[0].flat() == nets[1].flat()).all() and (nets[0].thresholds == nets[1].thresholds).all() and (nets[0].flat() != got.flat()).any()
    some = T.examples(docs.union(docs), labels.union(labels)).where("fitted")
    counts = T.counted(some)
    assert counts[T.TABLE].tolist() == [4 * sum(i >= 9000 for i in used), 4 * sum(i < 9000 for i in used)] and some.count() == len(used)


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    net = T.Network(rng.normal(size=(T.TABLE, T.DIM)), [rng.normal(size=(w, T.DIM, T.FILTERS)) for w in T.WIDTHS], [rng.normal(size=T.FILTERS) for _ in T.WIDTHS], rng.normal(size=len(T.WIDTHS) * T.FILTERS), 0.3)
    texts, toxic, heavy = [[f"w{x}" for x in rng.integers(0, 9, n)] for n in (1, 2, 40)], np.array([1, 0, 1]), np.array([0.3, 2.0, 0.7])
    loss = lambda n: sum(h * np.log1p(np.exp(-plain(n, t) if y else plain(n, t))) for t, y, h in zip(texts, toxic, heavy))
    rows, g_rows, g, g_base = T._gradient(net, T.Coded(texts), np.arange(3), heavy, toxic)
    flat, want = net.flat(), np.zeros_like(net.flat())
    np.add.at(want, rows, g_rows)
    rest = np.concatenate([*(p.ravel() for p in g), [g_base]])
    want[T.TABLE :].ravel()[: len(rest)] = rest
    for row in [*T.word_rows("w3"), *range(T.TABLE, len(flat) - 1, 5)]:
        for d in (0, 5):
            up, down = flat.copy(), flat.copy()
            up[row, d] += 1e-5
            down[row, d] -= 1e-5
            assert abs((loss(net.with_flat(up)) - loss(net.with_flat(down))) / 2e-5 - want[row, d]) < 1e-4
