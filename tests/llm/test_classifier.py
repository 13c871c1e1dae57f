import math
import re
import unicodedata
import zlib

import numpy as np

from threadloom.llm import boosting, classifier


def test_held_out_accuracy(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in classifier.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    told = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in told]) > 0.95


def test_labels_of_held_out_rows_are_not_used(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", classifier.F.when(classifier.held_out(), 1 - classifier.F.col("quality")).otherwise(classifier.F.col("quality")))
    a = {(r.doc_id, r.score) for r in classifier.quality_scores(docs, labels).collect()}
    assert a == {(r.doc_id, r.score) for r in classifier.quality_scores(docs, turned).collect()}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (3, "w " * 50_000, None), (3, "w " * 50_000, None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (3, 1)], "doc_id long, quality int")
    for few in (labels, labels.limit(0)):
        assert len(classifier.quality_scores(docs, few).collect()) == 4
    assert classifier.quality_scores(docs.limit(0), labels).count() == 0


def test_trees_by_array_walk_and_by_nodes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x, y)

    def walk(row):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return total

    assert np.allclose(model.raw(x[:100]), [walk(r) for r in x[:100]])
    assert ((model.predict(x) > 0.5) == y).mean() > 0.95
    assert 0 < boosting.fit(x[:3], y[:3]).predict(x[:1])[0] < 1


def features_plainly(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(words), sum(map(len, words))
    seen, repeated = {}, set()
    for i in range(n - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeated.update(j for i in places for j in range(i, i + 5))
    count = lambda pattern: len(re.findall(pattern, text))
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    return [
        math.log(1 + n), math.log(1 + len(lines)), chars / max(n, 1), count(r"[#*$%&|<>]") / max(n, 1), upper / max(chars, 1), (len(lines) - len(set(lines))) / max(len(lines), 1),
        len(repeated) / max(n, 1), len(set(words)) / max(n, 1), count("[0-9]") / max(chars, 1), count("[,;:!?]") / max(n, 1), count(r"\.") / max(n, 1), n / max(len(lines), 1),
    ]


def test_features_by_plain_rules(spark, sf_tiny):
    docs = spark.read.parquet(f"{sf_tiny}/documents.parquet").select("doc_id", "text").limit(150)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b c d e a b c d e\n\n A\nA\n #1."), (-4, "Ä " * 40)], "doc_id long, text string")
    both = docs.union(odd)
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    got = {r.doc_id: [r[k] for k in classifier.FEATURES] for r in classifier.features(both).collect()}
    assert set(got) == set(texts) and all(np.allclose(got[i], features_plainly(t)) for i, t in texts.items())
