"""Exact top-k inner-product search by distributed histogram selection.

Components x become the integers floor(SCALE * x), so scores are exact. Nothing but counts
travels while the k-th value of every query is located: each task scores its vectors against
a block of queries and counts scores in BINS equal bins of each query's interval; the summed
histograms tell the bin of the k-th largest score, which is the next round's interval, until
it is one value wide. Then each task keeps scores at or above the value, of those equal to it
only the k smallest ids (no more can be needed), and a window ranks what is left.

A block holds at most QUERY_BYTES of queries, so what is broadcast does not grow with the
data; more queries mean more blocks, each one pass over the vectors.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part; a query meets only vectors of its own length and never rows of its own id; a query id
that occurs more than once is answered once, for its smallest vector; repeated rows are
candidates each; fewer than k candidates are all returned; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 1024
BINS = 256
#: Bytes of a block of queries, and queries in it, at most.
QUERY_BYTES, QUERIES = 8 << 20, 4096
#: Vectors scored at once within a task, and queries.
ROWS, COLUMNS = 2048, 256


def integers(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vec (array<long>) of the usable vectors."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fine).select(F.col(id_column).alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("vec"))


def _stack(vecs: pd.Series) -> np.ndarray:
    """A matrix in float64 where every inner product stays exact in it, else of Python integers."""
    m = np.stack([np.asarray(v, np.int64) for v in vecs])
    return m


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T  # 64-bit integers, as the score column holds them


def _blocks(frames: Iterator[pd.DataFrame], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for frame in frames:
        own = frame[frame["vec"].map(len) == dim]
        for at in range(0, len(own), ROWS):
            part = own.iloc[at : at + ROWS]
            if len(part):
                yield part["id"].to_numpy(np.int64), _stack(part["vec"])


def _count_round(spark: SparkSession, vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Histogram of the scores of each query: bin i holds low + i * width and up, the last bin
    also all above it; scores under low are not counted."""
    sent = spark.sparkContext.broadcast((ids, matrix, low, width))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, low, width = sent.value
        counts = np.zeros((len(ids), BINS), np.int64)
        for own, block in _blocks(frames, matrix.shape[1]):
            for at in range(0, len(ids), COLUMNS):
                part = slice(at, at + COLUMNS)
                scores = _scores(block, matrix[part])
                bins = np.minimum((scores - low[part]) // width[part], BINS - 1)
                use = (scores >= low[part]) & (own[:, None] != ids[part])
                flat = (bins + np.arange(bins.shape[1]) * BINS)[use]
                counts[part] += np.bincount(flat, minlength=bins.shape[1] * BINS).reshape(-1, BINS)
        q, b = np.nonzero(counts)
        yield pd.DataFrame({"q": q.astype(np.int32), "b": b.astype(np.int32), "n": counts[q, b]})

    # At most BINS rows a query come back, whatever the number of vectors.
    found = vectors.mapInPandas(run, "q int, b int, n long").groupBy("q", "b").agg(F.sum("n").alias("n")).toPandas()
    sent.unpersist()
    out = np.zeros((len(ids), BINS), np.int64)
    out[found["q"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    return out


def kth_values(spark: SparkSession, vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, largest: int, k: int) -> np.ndarray:
    """The k-th largest score of each query (its smallest, if there are fewer than k)."""
    reach = np.abs(matrix.astype(object)).sum(1) * largest + 1
    low = np.array([-r for r in reach], object)
    width = np.array([max(1, -(-2 * int(r) // BINS)) for r in reach], object)
    need = np.full(len(ids), k)
    fits = max(map(int, reach), default=0) < 2**61
    low, width = (x.astype(np.int64) for x in (low, width)) if fits else (np.full(len(ids), -(2**62)), np.full(len(ids), 2**63 // BINS))
    while True:
        counts = _count_round(spark, vectors, ids, matrix, low, width)
        above = np.cumsum(counts[:, ::-1], 1)[:, ::-1]  # scores in bin i or higher
        enough = above >= need[:, None]
        at = np.where(enough.any(1), BINS - 1 - np.argmax(enough[:, ::-1], 1), np.argmax(counts > 0, 1))
        low = low + at * width
        if (width == 1).all():
            return low
        # The last bin took all above it, so the k-th value stays the k-th of what is not under low.
        width = np.maximum(1, -(-width // BINS))


def _final(spark: SparkSession, vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    sent = spark.sparkContext.broadcast((ids, matrix, least))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, least = sent.value
        held: list[np.ndarray] = []

        def trimmed() -> np.ndarray:
            rows = np.concatenate(held) if held else np.zeros((0, 3), np.int64)
            rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
            first = np.searchsorted(rows[:, 0], np.arange(len(ids)))
            return rows[np.arange(len(rows)) - first[rows[:, 0]] < k]

        size = 0
        for own, block in _blocks(frames, matrix.shape[1]):
            for at in range(0, len(ids), COLUMNS):
                part = slice(at, at + COLUMNS)
                scores = _scores(block, matrix[part])
                r, q = np.nonzero((scores >= least[part]) & (own[:, None] != ids[part]))
                held.append(np.stack([q + at, scores[r, q], own[r]], 1))
                size += len(r)
            if size > 4 * k * len(ids) + 100_000:
                held = [trimmed()]
                size = len(held[0])
        rows = trimmed()
        yield pd.DataFrame({"query_id": ids[rows[:, 0]], "score": rows[:, 1], "vec_id": rows[:, 2]})

    return vectors.mapInPandas(run, "query_id long, score long, vec_id long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score. vectors, queries: id, vec (see integers)."""
    spark = vectors.sparkSession
    vectors = materialize(vectors, "vectors")
    asked = materialize(queries.where("id IS NOT NULL").groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec")), "queries")
    largest = vectors.select(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 0
    vectors = vectors.where("id IS NOT NULL")
    found = None
    for dim, n in sorted((r["dim"], r["count"]) for r in asked.groupBy("dim").count().collect()):
        blocks = max(1, -(-n // min(QUERIES, max(1, QUERY_BYTES // (8 * dim)))))
        for b in range(blocks):
            # A block's size follows from its hash; it is bounded, not the number of blocks.
            rows = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).select("id", "vec").toPandas().sort_values("id")
            if not len(rows):
                continue
            ids, matrix = rows["id"].to_numpy(np.int64), _stack(rows["vec"])
            least = kth_values(spark, vectors, ids, matrix, int(largest), k)
            part = _final(spark, vectors, ids, matrix, least, k)
            part = materialize(part, "found") if blocks > 1 else part
            found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
