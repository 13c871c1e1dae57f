"""Topic segments and verdicts: building, finding, resolving between machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .search import bm25, query_terms, small


def tag_prep(messages: DataFrame) -> DataFrame:
    """session_id, id, line: condensed lines of what is displayable."""
    return messages.where(X.is_displayable(F.col("content"))).select("session_id", "id", X.condense(F.col("uuid"), F.col("role"), X.strip_generated(F.col("content"))).alias("line"))


def resolve_segments(segments: DataFrame, messages: DataFrame) -> DataFrame:
    """segments (session_id, seg_no, start_ref) with start_id, start_uuid and status of the
    message whose uuid starts with start_ref: ok, not_found or ambiguous."""
    rows = segments.join(messages.select("session_id", F.col("id").alias("mid"), "uuid"), "session_id", "left")
    hit = F.startswith("uuid", F.lower("start_ref"))
    per = rows.groupBy("session_id", "seg_no", "start_ref").agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.struct("mid", "uuid"))).alias("m"))
    ok = F.col("n") == 1
    status = F.when(ok, "ok").when(F.col("n") == 0, "not_found").otherwise("ambiguous")
    return per.select("session_id", "seg_no", "start_ref", F.when(ok, F.col("m.mid")).alias("start_id"), F.when(ok, F.col("m.uuid")).alias("start_uuid"), status.alias("status"))


def build_segments(starts: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, start_uuid, end_uuid: a segment ends with the message before the next one's
    start, the last with the session; one whose next starts at the first message ends itself."""
    placed = messages.withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy("id"))).withColumn("size", F.count("*").over(Window.partitionBy("session_id")))
    at = starts.select("session_id", "start_uuid").join(placed.select("session_id", F.col("uuid").alias("start_uuid"), "rn", "size"), ["session_id", "start_uuid"])
    nxt = F.lead("rn").over(Window.partitionBy("session_id").orderBy("rn"))
    ends = at.withColumn("end_rn", F.greatest(F.coalesce(nxt - 1, F.col("size")), F.col("rn")))
    return ends.join(placed.select(F.col("session_id"), F.col("rn").alias("end_rn"), F.col("uuid").alias("end_uuid")), ["session_id", "end_rn"]).select("session_id", "start_uuid", "end_uuid")


def topic_for_message(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """id, topic of every message: of the segments (session_id, start_id, end_id, topic) around
    it the one that starts last; else the session's topic if it has only one."""
    w = Window.partitionBy("session_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    points = segments.select("session_id", F.col("start_id").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.struct("topic", "end_id").alias("s"))
    points = points.unionByName(messages.select("session_id", F.col("id").alias("at"), F.lit(1).alias("kind"), "id", F.lit(None).cast(points.schema["s"].dataType).alias("s")))
    held = points.withColumn("last", F.last("s", ignorenulls=True).over(w)).where("kind = 1")
    sole = segments.groupBy("session_id").agg(F.count("*").alias("n"), F.min("topic").alias("only")).where("n = 1")
    inside = F.when(F.col("last.end_id").isNull() | (F.col("at") <= F.col("last.end_id")), F.col("last.topic"))
    return held.join(sole, "session_id", "left").select("id", F.coalesce(inside, "only").alias("topic"))


def match_topics(segments: DataFrame, sessions: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, session_id, start_uuid, topic, score, rank: segments by BM25 over topic and
    summary. segments need a unique seg_id."""
    text = segments.withColumn("content", F.concat_ws(" ", "topic", "summary"))
    scored = bm25(text, query_terms(queries), "seg_id")
    rows = scored.join(segments, F.col("id") == F.col("seg_id")).join(sessions.select(F.col("id").alias("session_id"), "project"), "session_id", "left")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "seg_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "session_id", "start_uuid", "topic", "project", "score", "rank")


def topics_by_project(matches: DataFrame, roots: DataFrame, most: int = 5) -> DataFrame:
    """The best match of each (query, root, topic), at most so many a project."""
    rows = matches.join(roots.select(F.col("id").alias("session_id"), "root"), "session_id")
    one = Window.partitionBy("query_id", "root", "topic").orderBy("rank")
    few = Window.partitionBy("query_id", "project").orderBy("rank")
    kept = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").withColumn("place", F.row_number().over(few)).where(F.col("place") <= most)
    return kept.select("query_id", "project", "root", "topic", "place")


def session_topics(segments: DataFrame) -> DataFrame:
    """session_id, topics in order of their starts."""
    return segments.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_id", "topic"))), lambda s: s["topic"]), ",").alias("topics"))


def tagged_sessions(segments: DataFrame, verdicts: DataFrame) -> DataFrame:
    return segments.select("session_id").union(verdicts.select("session_id")).distinct()


def effective_routine(verdicts: DataFrame, segments: DataFrame) -> DataFrame:
    """session_id, routine: a routine verdict and no segment."""
    real = segments.where("topic <> ''").select("session_id").distinct().withColumn("real", F.lit(True))
    return verdicts.join(real, "session_id", "left").select("session_id", ((F.col("verdict") == "routine") & F.col("real").isNull()).alias("routine"))


def segment_sets(segments: DataFrame) -> DataFrame:
    """session_id, origin_machine, hash of each machine's set of segments, without empty sets."""
    rows = segments.where("topic <> ''").groupBy("session_id", "origin_machine").agg(F.collect_list(F.struct("start_uuid", "end_uuid", "topic", "summary")).alias("s"))
    return rows.select("session_id", "origin_machine", X.segment_hash(F.col("s")).alias("hash"))


def resolve_tags(sets: DataFrame) -> DataFrame:
    """session_id, origin_machine, hash, conflict: the set of the highest machine (then hash);
    different sets of a session are a conflict."""
    per = sets.groupBy("session_id").agg(F.max(F.struct("origin_machine", "hash")).alias("m"), (F.countDistinct("hash") > 1).alias("conflict"))
    return per.select("session_id", "m.origin_machine", "m.hash", "conflict")


def tag_changes(resolved: DataFrame, current: DataFrame) -> DataFrame:
    """The resolved sets that differ from the current ones in hash or machine."""
    return resolved.join(current, ["session_id", "hash", "origin_machine"], "left_anti")


def upsert_by_key(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with new rows in place of those of equal keys; the later of equal new ones by tagged_at."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc("tagged_at"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def annotate_hits(hits: DataFrame, topics: DataFrame, previews: DataFrame, activity: DataFrame) -> DataFrame:
    """hits (query_id, id, session_id, rank) with label (the topic, else the preview) and activity."""
    rows = hits.join(topics, "id", "left").join(previews, "session_id", "left").join(activity, "session_id", "left")
    return rows.select("query_id", "rank", "id", "session_id", F.coalesce("topic", "preview").alias("label"), "activity")


def export_tags(segments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """session_id, document: one JSON text a tagged session with its segments and verdict."""
    rows = segments.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("start_uuid", "topic", "summary", "tagged_at"))).alias("segments"))
    v = verdicts.select("session_id", F.struct("verdict", "source", "tagged_at").alias("verdict"))
    both = rows.join(v, "session_id", "full_outer")
    return both.select("session_id", F.to_json(F.struct("session_id", "segments", "verdict")).alias("document"))
