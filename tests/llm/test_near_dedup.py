import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadloom.llm import near_dedup as nd
from threadloom.llm.common import Workspace


def rounded(x):
    """To 16 significant bits."""
    m, e = math.frexp(x)
    return math.ldexp(round(m * 65536), e - 16)


def brute(rows, similarity=nd.SIMILARITY):
    """doc_id -> class_id from exact sets of word tuples and every pair that shares one."""
    tf = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tf.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(s for c in tf for s in c)
    n = len(rows)
    ws = [{s: rounded((1 + math.log(n / max(df[s], nd.RARE * n, 2))) * k) for s, k in c.items()} for c in tf]
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, c in enumerate(tf):
        for s in c:
            holders[s].append(i)
    pairs = {(a, b) for v in holders.values() if len(v) < 400 for a in v for b in v if a < b}
    same = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        if tf[i]:
            same[t].append(i)
    pairs |= {(v[0], b) for v in same.values() for b in v[1:]}
    for a, b in pairs:
        x, y = ws[a], ws[b]
        both = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
        if both / (sum(x.values()) + sum(y.values()) - both) >= similarity:
            up[max(top(a), top(b))] = min(top(a), top(b))
    groups = defaultdict(list)
    for i in range(n):
        groups[top(i)].append(rows[i][0])
    return {d: min(g) for g in groups.values() for d in g}


def test_matches_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) < len(got)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "", "x"), (4, None, None), (5, " \n", "x"), (6, "a b", "x"), (7, "a  b", "x"), (8, "b a", "x"), (9, long, "x"), (10, long + " more", "x"), (10, long + " more", "x"), (None, "z y x w v u", None)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, tid string, want string")
    got = sorted([(r.doc_id or 0, r.class_id or 0) for r in nd.near_classes(docs).collect()])
    assert got == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (9, 9), (10, 9), (10, 9)]
    kept = nd.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id or 0 for r in kept.collect()]) == [0, 1, 3, 4, 5, 6, 8, 9]
    assert nd.near_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [200, 400])
def test_many_near_copies(spark, n):
    """A word put into each of 190 places of one text. With 200 words their similarity is 0.797, with 400 words 0.89."""
    base = [f"w{i}" for i in range(n)]
    rows = [(i, " ".join(base[:j] + [f"x{i}"] + base[j:])) for i, j in enumerate(range(5, 195))] + [(1000 + i, f"other {i} " + " ".join(f"o{i}_{j}" for j in range(50))) for i in range(50)]
    got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert len({got[i] for i in range(190)}) == (1 if n == 400 else 190)
    assert all(got[i] == i for i in got if i >= 1000)


@pytest.mark.parametrize("partitions", [1, 7])
def test_same_on_any_partitioning(spark, sf_small, partitions):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").where("doc_id < 300")
    a = {(r.doc_id, r.class_id) for r in nd.near_classes(docs.repartition(partitions)).collect()}
    assert a == {(r.doc_id, r.class_id) for r in nd.near_classes(docs).collect()}


def test_weighted_jaccard():
    def pack(d):
        return nd.packed(np.array(sorted(d), np.uint64) << np.uint64(8), np.array([d[k] for k in sorted(d)], np.float32)).tobytes()

    assert nd.weighted_jaccard(pack({1: 2.0, 5: 1.0}), pack({1: 1.0, 7: 4.0})) == pytest.approx(1 / 7)
    assert nd.weighted_jaccard(pack({1: 2.0}), pack({1: 2.0})) == 1
    assert nd.weighted_jaccard(pack({1: 3e6}), pack({1: 1.5e6})) == 0.5
    assert nd.weighted_jaccard(b"", b"") == 0


def test_one_shingle_many_times(spark):
    """Weights are not cut off: of 20,000 and 40,000 equal words the similarity is 0.5, of 40,000 and 41,000 it is 0.98."""
    rows = [(1, "w " * 20_000), (2, "w " * 40_000), (3, "w " * 41_000), (4, "v " * 41_000)]
    got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4}


@pytest.mark.parametrize("weights", [[8.0], [8.0, 16.0, 3.0, 24.0], [2.0, 5.0], [800.0, 1600.0]])
def test_samples_agree_as_often_as_sets_are_similar(weights):
    """Over 40 pairs of sets, samples of usual, heavier and lighter weights meet at the weighted Jaccard similarity."""
    rng, usual = np.random.default_rng(7), np.float32(8)
    agree, similar = [], []
    for _ in range(40):
        ids = np.unique(rng.integers(0, 1 << 48, 240, dtype=np.uint64))
        w = rng.choice(weights, len(ids)).astype(np.float32)
        other = np.where(rng.random(len(ids)) < 0.6, w, rng.choice(weights, len(ids))).astype(np.float32)
        a, b = slice(0, 200), slice(20, None)
        drawn = nd.samples(np.concatenate([ids[a], ids[b]]), np.concatenate([w[a], other[b]]), np.array([0, 200]), usual)
        assert (nd.samples(ids[b], other[b], np.array([0]), usual)[:, 0] == drawn[:, 1]).all()
        agree.append((drawn[:, 0] == drawn[:, 1]).mean())
        x, y = np.zeros(len(ids)), np.zeros(len(ids))
        x[a], y[b] = w[a], other[b]
        similar.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert np.mean(agree) == pytest.approx(np.mean(similar), abs=0.015)


def test_frequent_shingles_are_counted_exactly(spark, sf_tiny):
    texts = spark.read.parquet(f"{sf_tiny}/documents.parquet").repartition(5).select("text")
    with Workspace(spark) as work:
        n, floor, known, df = nd.document_frequencies(texts, work)
    every = Counter()
    for r in texts.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        every.update({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ())
    assert n == texts.count() and floor == 2
    assert sorted(df.tolist()) == sorted(v for v in every.values() if v > floor)


def test_links_are_as_in_all_pairs_of_a_family(spark):
    """Near copies of one text whose similarities lie on both sides of the limit: the classes are those of all pairs."""
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        text = list(base)
        for at in rng.choice(120, rng.integers(1, 6), replace=False):
            text[at] = f"x{i}_{at}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"o{i}_{j}" for j in range(60))) for i in range(600)]
    got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute(rows)
    assert got == want
    assert 2 < len({want[i] for i in range(150)}) < 150


def test_components_of_chains_stars_and_pieces(spark):
    """Against union-find, at once and in two steps."""
    rng = np.random.default_rng(5)
    names = [rng.bytes(16) for _ in range(400)]
    edges = [(i, i + 1) for i in range(0, 120)] + [(200, j) for j in range(201, 260)] + [(i, i) for i in range(300, 303)] + [(int(a), int(b)) for a, b in rng.integers(300, 400, (60, 2))]
    up = list(range(400))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[top(a)] = top(b)
    nodes = {i for e in edges for i in e if e[0] != e[1]}
    groups = defaultdict(list)
    for i in nodes:
        groups[top(i)].append(names[i])
    want = {n: min(g) for g in groups.values() for n in g}
    frame = lambda es: spark.createDataFrame([(names[a], names[b]) for a, b in es], "a binary, b binary")
    with Workspace(spark) as work:
        at_once = {bytes(r.node): bytes(r.comp) for r in nd.components(frame(edges), work).collect()}
        steps = nd.extended(nd.components(frame(edges[::2]), work), frame(edges[1::2]), work)
        assert at_once == want
        assert {bytes(r.node): bytes(r.comp) for r in steps.collect()} == want
        assert nd.components(frame([(0, 0)]), work).count() == 0
