"""Search from end to end: words and vectors, fused, one hit a lineage, labelled, with advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import written
from . import search as S
from . import sessions as O
from . import vectors as V
from .index import WordIndex


def nearest_messages(vectors: DataFrame, queries: DataFrame, messages: DataFrame, sessions: DataFrame, k: int = 10, subagents: bool = False, over: int = 3) -> DataFrame:
    """query_id, id, session_id, similarity, rank: of the over * k vectors (msg_id, session_id,
    vec) nearest to each query (query_id, qvec), the k first whose message is still there and,
    unless subagents are wanted, is in a top-level session."""
    ids = vectors.select(F.struct("msg_id", "session_id").alias("vec_id"), "vec")
    found = V.vector_knn(ids, queries, over * k).select("query_id", F.col("vec_id.msg_id").alias("id"), "similarity", F.col("rank").alias("_place"))
    s = sessions if subagents else sessions.where("NOT is_subagent")
    live = found.join(messages.select("id", "session_id"), "id").join(s.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    ranked = live.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_place")))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "session_id", "similarity", "rank")


def candidates(
    messages: DataFrame, sessions: DataFrame, queries: DataFrame, fetch: int, sort: str = "relevance", subagents: bool = False,
    index: WordIndex | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
) -> DataFrame:
    """query_id, id, session_id, uuid, ts_iso, coverage, rank, fused: hits by words and, where
    vectors are given and relevance is asked for, by nearness, fused by reciprocal ranks.
    Without any vector no query vector is asked for, so a plan that embeds the queries never runs."""
    hits = written(S.keyword_search(messages, sessions, queries, fetch, 8 * fetch, sort, subagents, index=index), "keyword")
    if sort != "relevance" or vectors is None or query_vectors is None or not vectors.limit(1).count():
        rows = hits.select("query_id", "id", "coverage", "rank", F.lit(0.0).alias("fused"))
    else:
        near = nearest_messages(vectors, query_vectors, messages, sessions, fetch, subagents)
        both = V.rrf_fuse(hits, near).select("query_id", "id", F.col("score").alias("fused"), "rank")
        rows = both.join(hits.select("query_id", "id", "coverage"), ["query_id", "id"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))
    return rows.join(messages.select("id", "session_id", "uuid", "ts_iso"), "id")


def full_search(
    messages: DataFrame, sessions: DataFrame, queries: DataFrame, limit: int = 8, fetch: int | None = None, sort: str = "relevance", subagents: bool = False,
    index: WordIndex | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, callers: DataFrame | None = None, roots: DataFrame | None = None,
    found: DataFrame | None = None,
) -> DataFrame:
    """query_id, rank, id, session_id, project, read_ref, ts_iso, missing, fused, total, has_more,
    widen_to, at_ceiling. In this order: candidates, without the caller's current turn; sorted;
    the best of each (project, lineage); rows without uuid left out; cut at limit. total counts
    what is left before the cut; where a query fetched as many rows as it may (at_ceiling), it
    is a lower bound, and there is more. found: the candidates, where they are known already."""
    fetch = fetch or 4 * limit
    rows = found if found is not None else written(candidates(messages, sessions, queries, fetch, sort, subagents, index, vectors, query_vectors), "candidates")
    ceiling = rows.groupBy("query_id").agg((F.count("*") >= fetch).alias("at_ceiling"))
    if callers is not None:
        rows = S.drop_current_turn(rows, messages, callers)
    rows = V.rank_candidates(rows, sort).drop("rank").withColumnRenamed("final_rank", "rank")
    kept = S.dedup_lineage(rows, roots if roots is not None else O.lineage_root(sessions), sessions)
    told = S.envelope(kept, limit).join(ceiling, "query_id").join(sessions.select(F.col("id").alias("session_id"), F.col("missing_since").isNotNull().alias("missing")), "session_id", "left")
    more = F.col("has_more") | F.col("at_ceiling")
    return told.select(
        "query_id", "rank", "id", "session_id", "project", X.read_ref(F.col("session_id"), F.col("uuid")).alias("read_ref"), "ts_iso", "missing", "fused", "total",
        more.alias("has_more"), F.when(more, F.greatest(F.lit(4 * limit), F.lit(20))).alias("widen_to"), "at_ceiling",
    )


def scope_states(scopes: DataFrame) -> DataFrame:
    """scope, state and detail of scopes (scope, in_store, error, busy, n_rows): not_consolidated,
    skipped_error, stale_fallback, empty or searched; complete is false for the first three."""
    error = F.coalesce(F.col("error"), F.lit(""))
    state = F.when(~F.col("in_store"), "not_consolidated").when((error != "") & ~F.col("busy"), "skipped_error").when(F.col("busy"), "stale_fallback").when(F.col("n_rows") == 0, "empty").otherwise("searched")
    rows = scopes.select("scope", state.alias("state"), F.nullif(error, F.lit("")).alias("detail"))
    return rows.withColumn("complete", F.col("state").isin("searched", "empty"))


def advisories(results: DataFrame, states: DataFrame, sort: str = "relevance", dropped: DataFrame | None = None, store_note: str = "") -> DataFrame:
    """query_id, ord, code, detail: what a reader should know of results (query_id, rank, ts_iso,
    project, total, at_ceiling). In fixed order: recency_skew, broad_query, current_turn_excluded,
    scope_incomplete, not_consolidated, store_fallback, project_spread, raw_history. dropped: query_id, n rows left
    out as the caller's own; states: as of scope_states."""
    per = results.groupBy("query_id").agg(
        F.max("ts_iso").alias("newest"), F.min_by("ts_iso", "rank").alias("top"), F.max("total").alias("total"), F.bool_or("at_ceiling").alias("ceiling"), F.countDistinct("project").alias("projects"),
        F.array_join(F.slice(F.array_sort(F.collect_set("project")), 1, 5), ",").alias("sample"),
    )
    if dropped is not None:
        per = per.join(dropped.select("query_id", F.col("n").alias("dropped")), "query_id", "left")
    counts = states.agg(F.count("*").alias("scopes"), *[F.count_if(F.col("state") == s).alias(s) for s in ("skipped_error", "stale_fallback", "not_consolidated")])  # one row
    rows = per.join(F.broadcast(counts))
    seconds = lambda c: X.iso_to_epoch(F.coalesce(c, F.lit("")))
    skewed = (F.lit(sort == "relevance")) & (seconds(F.col("newest")) - seconds(F.col("top")) > 86_400)
    own = F.coalesce(F.col("dropped"), F.lit(0)) if dropped is not None else F.lit(0)
    text = lambda c: c.cast("string")
    told = [
        ("recency_skew", skewed, F.left("newest", F.lit(10))),
        ("broad_query", F.col("ceiling") | (F.col("total") >= 20), text(F.col("total"))),
        ("current_turn_excluded", own > 0, text(own)),
        ("scope_incomplete", F.col("skipped_error") + F.col("stale_fallback") > 0, F.concat_ws(",", text(F.col("scopes")), text(F.col("skipped_error")), text(F.col("stale_fallback")))),
        ("not_consolidated", F.col("not_consolidated") > 0, text(F.col("not_consolidated"))),
        ("store_fallback", F.lit(bool(store_note)), F.lit(store_note)),
        ("project_spread", F.col("projects") >= 2, F.concat_ws(",", text(F.col("projects")), F.col("sample"))),
        ("raw_history", F.lit(True), F.lit(None).cast("string")),  # of every answer: these are transcripts, not the present state
    ]
    each = F.filter(F.array(*[F.struct(F.lit(i).alias("ord"), F.when(when, F.lit(code)).alias("code"), detail.alias("detail")) for i, (code, when, detail) in enumerate(told)]), lambda c: c["code"].isNotNull())
    return rows.select("query_id", F.explode(each).alias("w")).select("query_id", "w.ord", "w.code", "w.detail")
