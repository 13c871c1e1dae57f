"""Vectors: which texts to embed, what changed, exact nearest neighbours, rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import shared_path

#: Texts and bytes handed to an embedder at once.
BATCH_TEXTS, BATCH_BYTES = 128, 150_000
LEAST_LENGTH = 12
#: Vectors and queries that meet in one product.
ROWS, QUERIES = 2_048, 256


def vector_corpus(messages: DataFrame) -> DataFrame:
    """session_id, content_hash, msg_id, text of what is worth a vector: the stripped text of 12
    characters or more; of equal texts in a session the later row."""
    rows = messages.select("session_id", "id", X.strip_generated(F.col("content")).alias("text")).where(F.length("text") >= LEAST_LENGTH).withColumn("content_hash", X.content_hash(F.col("text")))
    return rows.groupBy("session_id", "content_hash").agg(F.max("id").alias("msg_id"), F.max_by("text", "id").alias("text"))


def vector_delta(corpus: DataFrame, vectors: DataFrame, max_new: int | None = None) -> DataFrame:
    """session_id, content_hash, msg_id, action: embed, repoint, prune or keep."""
    have = vectors.select("session_id", "content_hash", F.col("msg_id").alias("old_id"))
    both = corpus.join(have, ["session_id", "content_hash"], "full_outer")
    action = F.when(F.col("old_id").isNull(), "embed").when(F.col("msg_id").isNull(), "prune").when(F.col("old_id") != F.col("msg_id"), "repoint").otherwise("keep")
    rows = both.select("session_id", "content_hash", F.coalesce("msg_id", "old_id").alias("msg_id"), action.alias("action"))
    if max_new is None:
        return rows
    first = rows.where("action = 'embed'").orderBy("msg_id").limit(max_new)
    return rows.where("action <> 'embed'").unionByName(first)


def embed_corpus(corpus: DataFrame, embed: Callable[[list[str]], list[list[float] | None]]) -> DataFrame:
    """Vectors of corpus (session_id, content_hash, msg_id, text) by an embedder of text lists;
    texts it fails on are tried alone, and those without a vector are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def vectors(texts: list[str]) -> list[list[float] | None]:
            try:
                found = embed(texts)
                if len(found) == len(texts):
                    return found
            except Exception:
                if len(texts) == 1:
                    return [None]
            return [v for t in texts for v in vectors([t])] if len(texts) > 1 else [None]

        for frame in frames:
            out, at = [], 0
            texts = frame["text"].tolist()
            while at < len(texts):
                end, room = at, BATCH_BYTES
                while end < len(texts) and end - at < BATCH_TEXTS and (end == at or room >= len(texts[end].encode())):
                    room -= len(texts[end].encode())
                    end += 1
                out += vectors(texts[at:end])
                at = end
            frame = frame.drop(columns="text").assign(vec=out)
            yield frame[[v is not None for v in out]]

    return corpus.select("session_id", "content_hash", "msg_id", "text").mapInPandas(run, "session_id string, content_hash string, msg_id long, vec array<float>")


def _pool(pool: list[tuple[np.ndarray, np.ndarray, pa.Array]], k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The k best of each query: query, similarity, vector id; by similarity, then larger id."""
    query, sim = (np.concatenate([p[i] for p in pool]) for i in (0, 1))
    ids = pa.concat_arrays([p[2] for p in pool])
    keys = ids.flatten() if pa.types.is_struct(ids.type) else [ids]
    ranks = [pc.rank(x, "descending", tiebreaker="dense").to_numpy() for x in keys]
    order = np.lexsort([*reversed(ranks), -sim, query])
    query, sim = query[order], sim[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < k
    return query[keep], sim[keep], ids.take(pa.array(order[keep]))


def vector_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, most_queries: int = 5_000) -> DataFrame:
    """query_id, vec_id, similarity (nine decimals), rank: the k most similar vectors of equal
    length for each query (query_id, qvec), by cosine in double precision, then larger id; a zero
    norm counts as 1. Queries are met in blocks of most_queries at most, by hash, which is all
    that is sent to the tasks; a task takes matrix products of QUERIES queries and ROWS vectors, of
    which the k best of each query are kept, so that it holds no more than these and one product,
    and only these are shuffled."""
    spark = vectors.sparkSession
    kind, asked_kind = (d.schema[c].dataType.simpleString() for d, c in ((vectors, "vec_id"), (queries, "query_id")))
    asked = queries.where("qvec IS NOT NULL").select("query_id", "qvec")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("vec_id"))

    def met(block: DataFrame) -> DataFrame:
        rows = block.toArrow()
        names, qvecs = rows.column("query_id").combine_chunks(), rows.column("qvec").combine_chunks()
        dims = pc.list_value_length(qvecs).to_numpy()
        flat, start = qvecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(dims)]
        groups = {}
        for dim in np.unique(dims):  # the queries of each length, as unit rows
            which = np.flatnonzero(dims == dim)
            m = np.stack([flat[start[i] : start[i] + dim] for i in which]).reshape(len(which), dim)
            norm = np.sqrt((m * m).sum(1))
            groups[int(dim)] = (which, m, np.where(norm == 0, 1.0, norm))
        sent = spark.sparkContext.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, least = [], 0, np.full(len(dims), -np.inf)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    ids, vecs = batch.column(0), batch.column(1)
                    lens = pc.fill_null(pc.list_value_length(vecs), -1).to_numpy(zero_copy_only=False)
                    values = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    begin = np.cumsum(np.maximum(lens, 0)) - np.maximum(lens, 0)
                    for dim, (which, m, norm) in sent.value.items():
                        own = np.flatnonzero(lens == dim)
                        if not len(own):
                            continue
                        v = values[begin[own][:, None] + np.arange(dim)]
                        lengths = np.sqrt((v * v).sum(1))
                        lengths = np.where(lengths == 0, 1.0, lengths)
                        for at_q in range(0, len(which), QUERIES):
                            some = which[at_q : at_q + QUERIES]
                            sims = np.round((m[at_q : at_q + QUERIES] @ v.T) / (norm[at_q : at_q + QUERIES, None] * lengths), 9)
                            floor = least[some]
                            if len(own) > k:  # what is under the batch's own k-th is not among the best
                                floor = np.maximum(floor, np.partition(np.where(np.isnan(sims), -np.inf, sims), -k, axis=1)[:, -k])
                            q, j = np.nonzero(sims >= floor[:, None])
                            held.append((some[q], sims[q, j], ids.take(pa.array(own[j]))))
                            size += len(q)
                            if size > 4 * k * len(dims) + 10_000:
                                held = [_pool(held, k)]
                                size = len(held[0][0])
                                full = np.bincount(held[0][0], minlength=len(dims)) >= k
                                last = np.searchsorted(held[0][0], np.arange(len(dims)), "right") - 1
                                least[full] = held[0][1][last[full]]
            if held:
                query, sim, ids = _pool(held, k)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids, pa.array(sim)], ["query_id", "vec_id", "similarity"])

        found = vectors.select("vec_id", "vec").mapInArrow(run, f"query_id {asked_kind}, vec_id {kind}, similarity double")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    blocks = -(-asked.count() // most_queries)
    if blocks <= 1:
        return met(asked)
    path = shared_path(spark, "knn")
    for i in range(blocks):
        met(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).write.parquet(f"{path}/block={i}")
    return spark.read.schema(f"query_id {asked_kind}, vec_id {kind}, similarity double, rank int").parquet(*[f"{path}/block={i}" for i in range(blocks)])


def rrf_fuse(keyword: DataFrame, vector: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, id, score (nine decimals), in_keyword, in_vector, rank of two ranked lists
    (query_id, id, rank) by reciprocal ranks; ties go to the smaller id."""
    a, b = keyword.select("query_id", "id", F.col("rank").alias("a")), vector.select("query_id", "id", F.col("rank").alias("b"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    score = F.round(F.coalesce(X.rrf_term(F.col("a")), F.lit(0.0)) + F.coalesce(X.rrf_term(F.col("b")), F.lit(0.0)), 9)
    rows = both.select("query_id", "id", score.alias("score"), F.col("a").isNotNull().alias("in_keyword"), F.col("b").isNotNull().alias("in_vector"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def rank_candidates(hits: DataFrame, sort: str = "relevance") -> DataFrame:
    """hits (query_id, id, fused, coverage, rank, ts_iso) in final order as final_rank; an empty
    time is first when the oldest come first, last otherwise."""
    order = {"relevance": [F.desc("fused"), F.desc("coverage"), F.col("rank")], "newest": [F.desc("ts_iso"), F.col("rank")], "oldest": [F.col("ts_iso"), F.col("rank")]}[sort]
    return hits.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "id")))
