import math

import numpy as np

from threadloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if queries(i)}):
        own = min(v for i, v in usable if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q and len(v) == len(own))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def run(frame, every, k):
    ints = topk.integers(frame)
    return sorted(tuple(r) for r in topk.top_k(ints, ints.where(f"id % {every} = 0"), k).collect())


def test_corpus(spark, sf_small):
    frame = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert run(frame, 100, 10) == sorted(brute(rows, lambda i: i % 100 == 0, 10))


def test_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, -2.0], 0) for i in range(40)] + [(i, rng.normal(size=2).tolist(), 0) for i in range(40, 80)]
    rows += [(80, None, 0), (81, [], 0), (82, [None, 1.0], 0), (84, [float("nan"), 1.0], 0), (88, [float("inf"), 1.0], 0), (90, [1.0], 0), (92, [2.0], 0), (100, [9e4, -8e5], 0), (7, [1.0, -2.0], 0), (20, [3.0, 3.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for k in (1, 10, 200):
        assert run(frame, 4, k) == sorted(brute([r[:2] for r in rows], lambda i: i % 4 == 0, k))
    assert run(frame.limit(0), 4, 3) == []
