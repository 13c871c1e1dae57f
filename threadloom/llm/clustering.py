"""Centroid clustering with n-simplex bounds.

Components x become the integers floor(SCALE * x). PIVOTS of the starting vectors are pivots:
every vector's squared distances to them are computed once and stored beside it. The pivots span
a simplex; by its triangular base a row of stored distances becomes an apex, whose first
coordinates lie in the pivots' plane and whose last is its height above it. Between two apexes
the Euclidean distance is a lower bound of the distance of what they stand for, and with one
height turned down an upper bound. A round computes the apexes of its centroids, and each task
drops the centroids whose lower bound is above the least upper bound; only the rest are compared
in exact integers. Where a pivot adds (almost) nothing to the plane of those before it, it is
left out, and bounds leave room for rounding, so pruning never changes a result.

A task adds up its vectors by cluster before anything is shuffled, so a hot cluster is a row a
component and task. The driver holds the centroids only: CENTROIDS rows.

Defined results: vectors that are null, of another length than DIM, or hold null or non-finite
components take no part; a null vec_id takes part, but no start is taken from it; repeated rows
count each, and as starts, in the order of their vectors; with fewer vectors than CENTROIDS
there are fewer centroids; integers, distances and their sums are 64-bit, larger ones are the
largest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, materialize

SCALE, DIM = 64, 64
CENTROIDS, ROUNDS, PIVOTS = 16, 3, 6
#: Vectors handled at once within a task.
ROWS = 4096
LARGEST = 2**63 - 1
#: Share of the largest squared distance that bounds may be off by; a pivot whose height above
#: the plane of the others is a smaller share than FLAT of its distance is left out.
SLACK, FLAT = 1e-7, 1e-2


def integers(vectors: DataFrame, dim: int = DIM, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, vec (array<long>) of the usable vectors."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fine).select(F.col(id_column).alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("vec"))


def starts(vectors: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The k vectors of smallest sha256 of 1:<vec_id>, in that order."""
    named = vectors.where("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    return [list(r["vec"]) for r in named.orderBy("h", "vec").limit(k).collect()]


def _matrix(rows: list) -> np.ndarray:
    """Integers as int64 where every squared distance and its sums fit float64 exactly, else as Python integers."""
    m = np.array([np.asarray(r, np.int64) for r in rows])
    return m if not m.size or (m > -(2**20)).all() and (m < 2**20).all() else m.astype(object)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices."""
    if a.dtype == object or b.dtype == object:
        return ((a.astype(object)[:, None, :] - b.astype(object)[None, :, :]) ** 2).sum(2)
    x, y = a.astype(np.float64), b.astype(np.float64)  # below 2 ** 53, so exact
    return np.rint((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)


@dataclass
class Simplex:
    #: The pivots that are used, by their place among those given.
    used: list[int]
    #: Coordinates of the used pivots but the first, in a plane with the first as origin.
    base: np.ndarray

    @classmethod
    def of(cls, pivots: np.ndarray) -> Simplex:
        used, base = [0], np.zeros((0, 0))
        for i in range(1, len(pivots)):
            to = squares(pivots[[i]], pivots[[*used]]).astype(np.float64)
            apex = cls(used, base).apex(to)[0]
            if apex[-1] > FLAT * np.sqrt(to[0, 0]) and to[0, 0] > 0:
                base = np.block([[base, np.zeros((len(base), 1))], [apex]])
                used = [*used, i]
        return cls(used, base)

    def apex(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates of rows of squared distances to the used pivots; the last is the height."""
        d = distances.astype(np.float64)
        flat = np.zeros((len(d), len(self.base)))
        for j, corner in enumerate(self.base):  # forward substitution down the triangle
            flat[:, j] = ((d[:, 0] - d[:, j + 1] + corner @ corner) / 2 - flat[:, :j] @ corner[:j]) / corner[j]
        return np.hstack([flat, np.sqrt(np.maximum(d[:, :1] - (flat**2).sum(1, keepdims=True), 0))])


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances between what two sets of apexes stand for."""
    plane = np.maximum((a[:, :-1] ** 2).sum(1)[:, None] - 2 * a[:, :-1] @ b[:, :-1].T + (b[:, :-1] ** 2).sum(1), 0)
    return plane + (a[:, -1:] - b[:, -1]) ** 2, plane + (a[:, -1:] + b[:, -1]) ** 2


def nearest(vecs: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and exact squared distance of each vector, and how many centroids were
    compared. cached: the vectors' squared distances to the pivots."""
    if vecs.dtype == object or centroids.dtype == object or pivots.dtype == object:
        keep = np.ones((len(vecs), len(centroids)), bool)  # no bounds where float64 is too coarse
    else:
        ours, theirs = simplex.apex(cached[:, simplex.used]), simplex.apex(squares(centroids, pivots[simplex.used]))
        low, high = bounds(ours, theirs)
        room = SLACK * ((ours**2).sum(1) + (theirs**2).sum(1).max() + 1)
        keep = low <= (high.min(1) + room)[:, None]
    best, at = np.full(len(vecs), -1, object if vecs.dtype == object or centroids.dtype == object else np.int64), np.full(len(vecs), -1)
    for c in range(len(centroids)):
        rows = np.flatnonzero(keep[:, c])
        if len(rows):
            d = squares(vecs[rows], centroids[[c]])[:, 0]
            closer = (at[rows] < 0) | (d < best[rows])
            best[rows[closer]], at[rows[closer]] = d[closer], c
    return at, best, int(keep.sum())


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for frame in frames:
        for at in range(0, len(frame), ROWS):
            part = frame.iloc[at : at + ROWS]
            yield part, _matrix(part["vec"])


def with_distances(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors with to_pivots, their squared distances to the pivots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, vecs in _batches(frames):
            d = np.minimum(squares(vecs, pivots), LARGEST).astype(np.int64)
            yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64"), "vec": part["vec"], "to_pivots": list(d)})

    return vectors.mapInPandas(run, "vec_id long, vec array<long>, to_pivots array<long>")


def _moved(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, dim = centroids.shape
        sums, counts = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for part, vecs in _batches(frames):
            at, _, _ = nearest(vecs, np.stack(part["to_pivots"]), centroids, pivots, simplex)
            for c in np.unique(at):
                sums[c] += vecs[at == c].sum(0).astype(object)
                counts[c] += (at == c).sum()
        c, d = (x.ravel() for x in np.indices((k, dim)))
        some = counts[c] > 0
        yield pd.DataFrame({"c": c[some], "d": d[some], "s": [Decimal(int(x)) for x in sums.ravel()[some]], "n": counts[c[some]]})

    parts = stored.mapInPandas(run, "c int, d int, s decimal(38,0), n long")
    found = parts.groupBy("c", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # a row a centroid and component
    out = centroids.astype(object)
    for r in found:
        out[r["c"], r["d"]] = int(r["s"]) // r["n"]
    return _matrix(list(out))


def assign(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray, simplex: Simplex) -> DataFrame:
    """vec_id, cluster, distance, compared (centroids compared exactly)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, vecs in _batches(frames):
            at, best, compared = nearest(vecs, np.stack(part["to_pivots"]), centroids, pivots, simplex)
            yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64"), "cluster": at, "distance": np.minimum(best, LARGEST).astype(np.int64), "compared": np.r_[compared, np.zeros(len(at) - 1, int)] if len(at) else 0})

    return stored.mapInPandas(run, "vec_id long, cluster int, distance long, compared long")


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, n_pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of vectors (vec_id,
    vec; see integers)."""
    spark = vectors.sparkSession
    first = starts(vectors, k)
    if not first:
        return _empty(spark)
    centroids = _matrix(first)
    pivots = centroids[:n_pivots]
    simplex = Simplex.of(pivots) if pivots.dtype != object else Simplex([0], np.zeros((0, 0)))
    with Workspace(spark) as work:
        stored = work.save(with_distances(vectors, pivots), "pivots")
        for _ in range(rounds):
            centroids = _moved(stored, centroids, pivots, simplex)
        found = work.save(assign(stored, centroids, pivots, simplex), "assigned")
        per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a centroid
        names = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in centroids]
        rows = [(r["cluster"], min(int(r["s"]), LARGEST), min(sum(int(x["s"]) for x in per), LARGEST), names[r["cluster"]]) for r in per]
        told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return materialize(found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")
