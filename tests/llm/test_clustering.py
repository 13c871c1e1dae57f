import hashlib
import math

import numpy as np

from threadloom.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16, rounds=3):
    """Plain integer k-means; rows of 64 components as Python floats."""
    vecs = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in vecs if i is not None)[:k]
    cents = [v for _, v in start]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def near(v):
        return min((square(v, c), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in vecs]
        groups = [[v for (_, v), a in zip(vecs, at) if a == j] for j in range(len(cents))]
        cents = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, cents)]
    told = [(i, *near(v)) for i, v in vecs]
    cap = lambda x: min(x, 2**63 - 1)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, cap(d), cap(sum(cap(e) for _, e, b in told if b == j)), cap(sum(cap(e) for _, e, _ in told)), names[j]) for i, d, j in told), key=str)


def run(frame):
    return sorted((tuple(r) for r in clustering.clusters(clustering.integers(frame)).collect()), key=str)


def test_corpus(spark, sf_small):
    frame = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    assert run(frame) == brute([(r.vec_id, r.embedding) for r in frame.collect()])


def test_ties_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    line = lambda *x: [*map(float, x), *[0.0] * (64 - len(x))]
    rows = [(i, line(i % 5, (i // 5) % 3), 0) for i in range(60)] + [(7, line(2, 1), 0)] * 30 + [(i, rng.normal(size=64).tolist(), 0) for i in range(60, 90)]
    rows += [(None, line(1, 1), 0), (91, None, 0), (92, [], 0), (93, [1.0] * 63, 0), (94, line(float("nan")), 0), (95, line(float("inf")), 0), (96, [None] * 64, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert run(frame) == brute([r[:2] for r in rows])
    few = frame.where("vec_id < 5")
    assert run(few) == brute([r[:2] for r in rows if r[0] is not None and r[0] < 5])
    assert run(frame.limit(0)) == []


def test_components_beyond_float_precision(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 9)).tolist(), 0) for i in range(60)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute([r[:2] for r in rows])


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    heads = rng.integers(-300, 300, (16, 64))
    vecs = (heads[rng.integers(0, 16, 3000)] + rng.integers(-40, 40, (3000, 64))).astype(np.int64)
    for pivots in (heads[:6], np.vstack([heads[:2], heads[:2], heads[:1] * 2 - heads[1:2], heads[5:6]])):
        simplex = clustering.Simplex.of(pivots)
        cached, exact = clustering.squares(vecs, pivots), clustering.squares(vecs, heads)
        low, high = clustering.bounds(simplex.apex(cached[:, simplex.used]), simplex.apex(clustering.squares(heads, pivots[simplex.used])))
        assert (low <= exact * (1 + 1e-7) + 1e-3).all() and (high >= exact * (1 - 1e-7) - 1e-3).all()
        at, best, compared = clustering.nearest(vecs, cached, heads, pivots, simplex)
        assert (at == exact.argmin(1)).all() and (best == exact.min(1)).all() and compared < vecs.shape[0] * 16
    assert len(clustering.Simplex.of(np.vstack([heads[:2], heads[:2], heads[:1] * 2 - heads[1:2]])).used) == 2
