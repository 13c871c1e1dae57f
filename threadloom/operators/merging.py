"""Many sources in one store: merges, change marks, retention, deletion, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sessions import build_sessions

DAY = 86_400.0


def merge_messages(messages: DataFrame, keep_blank: bool = True) -> DataFrame:
    """messages (with store, smaller first) without copies: of (session_id, uuid) the smallest
    (store, id) stays. new_id numbers each session's rows by (store, first id). Rows without a
    uuid are all kept, or with keep_blank=False are one row a session."""
    key = F.when((F.col("uuid") != "") | F.lit(not keep_blank), F.col("uuid")).otherwise(F.concat_ws(":", F.lit("\x00"), F.col("store").cast("string"), F.col("id").cast("string")))
    first = Window.partitionBy("session_id", "_key").orderBy("store", "id")
    rows = messages.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_key")
    return rows.withColumn("new_id", F.row_number().over(Window.partitionBy("session_id").orderBy("store", "id")))


def merge_sessions(sessions: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """One row a session id of sessions (with store): earliest positive start, latest end, missing
    only where every copy is, a subagent if any copy is; parent, tool and machine of the first
    copy that has them; project and cwd of the present, then longest, then first copy that has
    one. message_count is recounted from merged messages where given."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("store"))).alias(c)
    rank = F.struct(F.col("missing_since").isNull().alias("present"), F.col("message_count").alias("n"), (-F.col("store")).alias("o"))
    scope = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c)
    rows = sessions.groupBy("id").agg(
        F.min(F.when(F.col("started_at") > 0, F.col("started_at"))).alias("started_at"), F.max("last_ts").alias("last_ts"), F.max("message_count").alias("message_count"),
        F.bool_or("is_subagent").alias("is_subagent"), first("parent_id"), first("source_tool"), first("origin_machine"), scope("project"), scope("cwd"),
        F.when(F.count("missing_since") == F.count("*"), F.min("missing_since")).alias("missing_since"),
    )
    if merged is None:
        return rows
    counts = merged.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("_n"))
    return rows.join(counts, "id", "left").withColumn("message_count", F.coalesce("_n", F.lit(0))).drop("_n")


def merge_topics(segments: DataFrame) -> DataFrame:
    """Of each (session_id, start_uuid) the segment of the higher machine, then the later one."""
    w = Window.partitionBy("session_id", "start_uuid").orderBy(F.desc("origin_machine"), F.desc("tagged_at"), "topic")
    return segments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_verdicts(verdicts: DataFrame) -> DataFrame:
    """Of each session the later verdict, then that of the higher machine."""
    w = Window.partitionBy("session_id").orderBy(F.desc("tagged_at"), F.desc("origin_machine"), "verdict")
    return verdicts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sync_marks(messages: DataFrame, sessions: DataFrame, segments: DataFrame, by: str = "source_tool") -> DataFrame:
    """source, mark: sessions, messages, largest id and the segments' count and latest time."""
    per = messages.join(sessions.select(F.col("id").alias("session_id"), F.col(by).alias("source")), "session_id").groupBy("source").agg(F.countDistinct("session_id").alias("s"), F.count("*").alias("m"), F.max("id").alias("x"))
    tagged = segments.join(sessions.select(F.col("id").alias("session_id"), F.col(by).alias("source")), "session_id").groupBy("source").agg(F.count("*").alias("t"), F.max("tagged_at").cast("long").alias("at"))
    mark = F.concat_ws(":", F.col("s").cast("string"), F.col("m").cast("string"), F.col("x").cast("string"), F.concat(F.lit("t"), F.coalesce("t", F.lit(0)).cast("string"), F.lit("@"), F.coalesce("at", F.lit(0)).cast("string")))
    return per.join(tagged, "source", "left").select("source", mark.alias("mark"))


def changed_sources(marks: DataFrame, known: DataFrame) -> DataFrame:
    """Sources whose mark is new or other than the known one."""
    return marks.join(known, ["source", "mark"], "left_anti")


def sync_stats(messages: DataFrame, changed: DataFrame, sessions: DataFrame, marks: DataFrame) -> DataFrame:
    """One row: sources, skipped, sessions, messages of the changed sources."""
    rows = messages.join(sessions.select(F.col("id").alias("session_id"), F.col("source_tool").alias("source")), "session_id").join(changed.select("source"), "source", "left_semi")
    got = rows.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("messages"))
    return marks.agg(F.count("*").alias("sources")).join(F.broadcast(got)).join(F.broadcast(changed.agg(F.count("*").alias("_c")))).select("sources", (F.col("sources") - F.col("_c")).alias("skipped"), "sessions", "messages")


def unmerged_sources(sources: DataFrame, marks: DataFrame) -> DataFrame:
    return sources.join(marks.select("source"), "source", "left_anti")


def replace_sessions(stored: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """stored messages with those of the changed sessions (session_id) replaced by new."""
    return stored.join(changed.select("session_id").distinct(), "session_id", "left_anti").unionByName(new.select(*stored.columns))


def changed_files(listing: DataFrame, watermark: DataFrame) -> DataFrame:
    """Files that are new or differ in time (1 ms), size or fingerprint from the watermark."""
    w = watermark.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.col("fp").alias("_fp"))
    same = (F.col("path") == F.col("_path")) & (F.abs(F.col("mtime") - F.col("_mtime")) < 0.001) & (F.col("size") == F.col("_size")) & (F.col("fp") == F.col("_fp"))
    return listing.join(w, same, "left_anti")


def plan_sync(listing: DataFrame, replica: DataFrame, tombstones: DataFrame) -> DataFrame:
    """path, reason of files to copy: missing, size or fingerprint; never of deleted sessions."""
    r = replica.select("path", F.col("size").alias("_size"), F.col("fp").alias("_fp"))
    reason = F.when(F.col("_size").isNull(), "missing").when(F.col("size") != F.col("_size"), "size").when(F.col("fp") != F.col("_fp"), "fingerprint")
    alive = listing.withColumn("session_id", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)).join(tombstones, "session_id", "left_anti")
    return alive.join(r, "path", "left").select("path", reason.alias("reason")).where("reason IS NOT NULL")


def reconcile_retention(file_index: DataFrame, sessions: DataFrame, listing: DataFrame, tombstones: DataFrame) -> DataFrame:
    """session_id, action: prune deleted ones, clear the mark of files that are back, stamp
    files that went, none."""
    here = listing.select("path", F.lit(True).alias("here"))
    gone = tombstones.select("session_id", F.lit(True).alias("dead"))
    rows = file_index.select("path", "session_id").join(sessions.select(F.col("id").alias("session_id"), "missing_since"), "session_id", "left").join(here, "path", "left").join(gone, "session_id", "left")
    action = F.when(F.col("dead"), "prune").when(F.col("here") & F.col("missing_since").isNotNull(), "clear").when(F.col("here").isNull() & F.col("missing_since").isNull(), "stamp").otherwise("none")
    return rows.select("session_id", action.alias("action"))


def apply_retention(sessions: DataFrame, actions: DataFrame, now: float) -> DataFrame:
    """id, missing_since after the actions; pruned sessions are gone."""
    rows = sessions.join(actions.withColumnRenamed("session_id", "id"), "id", "left").where("action IS NULL OR action <> 'prune'")
    return rows.select("id", F.when(F.col("action") == "stamp", F.lit(now)).when(F.col("action") == "clear", F.lit(None)).otherwise(F.col("missing_since")).alias("missing_since"))


def retention_report(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def prune_tombstoned(sessions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """sessions without the deleted ones and their children by name."""
    top = F.split_part("id", F.lit("/"), F.lit(1))
    dead = tombstones.select(F.col("session_id").alias("_dead"))
    return sessions.join(dead, F.col("id") == F.col("_dead"), "left_anti").join(dead, top == F.col("_dead"), "left_anti")


def retained_sessions(sessions: DataFrame, tombstones: DataFrame, project: str | None = None, before: float | None = None, max_messages: int | None = None) -> DataFrame:
    """Top-level sessions whose files are gone and which nobody deleted."""
    s = sessions.where("missing_since IS NOT NULL AND NOT is_subagent").join(tombstones.select(F.col("session_id").alias("id")), "id", "left_anti")
    s = s.where(F.contains("project", F.lit(project))) if project else s
    s = s.where(F.col("last_ts") < before) if before is not None else s
    return s.where(F.col("message_count") <= max_messages) if max_messages is not None else s


def delete_plan(sessions: DataFrame, tombstones: DataFrame, file_index: DataFrame, own_machine: str, session: str | None = None, project: str | None = None, before: float | None = None, max_messages: int | None = None) -> DataFrame:
    """session_id, status, size, message_count of what a deletion would take: delete, retained
    (its file is gone) or foreign_refused (of another machine). Some criterion is needed; a
    session is named in full or by a prefix of eight characters or more."""
    if session is None and project is None and before is None and max_messages is None:
        raise ValueError("a deletion needs a criterion")
    s = sessions.join(tombstones.select(F.col("session_id").alias("id")), "id", "left_anti")
    if session is not None:
        s = s.where((F.col("id") == session) | F.startswith("id", F.lit(session)) if len(session) >= 8 else F.col("id") == session)
    s = s.where(F.col("project") == project) if project is not None else s
    s = s.where(F.col("last_ts") < before) if before is not None else s
    s = s.where(F.col("message_count") <= max_messages) if max_messages is not None else s
    status = F.when(F.col("origin_machine") != own_machine, "foreign_refused").when(F.col("missing_since").isNotNull(), "retained").otherwise("delete")
    files = file_index.select(F.col("session_id").alias("id"), "size")
    return s.join(files, "id", "left").select(F.col("id").alias("session_id"), status.alias("status"), F.coalesce("size", F.lit(0)).alias("size"), "message_count").distinct()


def delete_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count("*").alias("sessions"), F.sum("size").alias("bytes"), F.sum("message_count").alias("messages"))


def add_tombstones(tombstones: DataFrame, plan: DataFrame) -> DataFrame:
    return tombstones.select("session_id").union(plan.where("status IN ('delete', 'retained')").select("session_id")).distinct()


def propagate_deletes(replica: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Files of a replica that belong to deleted sessions."""
    return replica.withColumn("session_id", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)).join(tombstones, "session_id", "left_semi").select("path", "session_id")


def latest_manifest(manifests: DataFrame, own: str) -> DataFrame:
    """The newest manifest of every other machine (machine_id, dir, updated_at)."""
    w = Window.partitionBy("machine_id").orderBy(F.desc("updated_at"), "dir")
    return manifests.where(F.col("machine_id") != own).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def freshness_report(machines: DataFrame, now: float) -> DataFrame:
    """machine_id, age, stale: nothing for more than a day, or never anything."""
    age = now - F.col("last_commit")
    return machines.select("machine_id", F.greatest(age, F.lit(0.0)).alias("age"), F.coalesce(age > DAY, F.lit(True)).alias("stale"))


def orphan_projects(sessions: DataFrame, listed: DataFrame) -> DataFrame:
    """Projects (with their live sessions) that have no source folder any more (project)."""
    live = sessions.where("missing_since IS NULL").groupBy("project").agg(F.count("*").alias("live"))
    return live.join(listed.select("project").distinct(), "project", "left_anti").where("live > 0")


def backfill_scope(sessions: DataFrame, folders: DataFrame) -> DataFrame:
    """sessions with missing project and cwd taken from their folder (id, dir_project, dir_cwd);
    labels that are there stay, and none is invented."""
    rows = sessions.join(folders, "id", "left")
    return rows.withColumn("project", F.coalesce("project", F.nullif("dir_project", F.lit("")))).withColumn("cwd", F.coalesce("cwd", F.nullif("dir_cwd", F.lit("")))).drop("dir_project", "dir_cwd")


def verify_refresh(sessions: DataFrame, messages: DataFrame, listing: DataFrame, watermark: DataFrame) -> DataFrame:
    """session_id, fresh (the file equals its watermark), complete (no message is missing)."""
    stale = changed_files(listing, watermark).select("path", F.lit(True).alias("stale"))
    counted = build_sessions(messages).select("session_id", F.col("message_count").alias("n"))
    rows = watermark.select("path", "session_id").join(stale, "path", "left").join(counted, "session_id", "left").join(sessions.select(F.col("id").alias("session_id"), "message_count"), "session_id", "left")
    return rows.select("session_id", F.col("stale").isNull().alias("fresh"), (F.coalesce("n", F.lit(0)) >= F.coalesce("message_count", F.lit(0))).alias("complete"))


def assert_no_history_loss(vault: DataFrame, store: DataFrame) -> DataFrame:
    """One row of both counts; an error where the vault holds fewer sessions than the store."""
    held, had = vault.select("session_id").distinct().count(), store.select("id").distinct().count()
    if held < had:
        raise ValueError(f"the vault holds {held} sessions, the store {had}: a rebuild would lose history")
    return vault.sparkSession.sql(f"SELECT CAST({held} AS bigint) AS vault_sessions, CAST({had} AS bigint) AS store_sessions")


def union_sources(sources: dict[str, DataFrame], only: str | None = None) -> DataFrame:
    """All sources in one table with source_tool; only one of them if named."""
    out = None
    for name, rows in sources.items():
        if only in (None, name):
            rows = rows.withColumn("source_tool", F.lit(name))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise KeyError(f"no source {only}")
    return out
