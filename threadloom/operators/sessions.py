"""Sessions: roll-ups, statistics, lineage, previews, windows, outlines and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import written

#: Hops that a lineage is followed, at most.
HOPS = 64


def build_sessions(messages: DataFrame) -> DataFrame:
    """session_id, started_at, last_ts (0 is no time), message_count."""
    ts = F.nullif("ts", F.lit(0.0))
    return messages.groupBy("session_id").agg(F.min(ts).alias("started_at"), F.max(ts).alias("last_ts"), F.count("*").alias("message_count"))


def corpus_stats(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: sessions by kind, messages by role, first and last day."""
    day = F.left(F.nullif("ts_iso", F.lit("")), F.lit(10))
    m = messages.agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    s = sessions.agg(F.count_if(~F.col("is_subagent")).alias("top_level"), F.count_if("is_subagent").alias("subagents"))
    return s.join(F.broadcast(m))  # two rows of one each


def fleet_stats(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """project (null is the total), sessions, messages."""
    return sessions.rollup("project").agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"))


def session_counts(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("all_sessions"), F.count_if(~F.col("is_subagent")).alias("top_level"))


def list_projects(sessions: DataFrame) -> DataFrame:
    """project, n_sessions, rank by count, then label."""
    per = sessions.where(~F.col("is_subagent")).groupBy("project").agg(F.count("*").alias("n_sessions"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_sessions"), "project")))


def distinct_scopes(sessions: DataFrame) -> DataFrame:
    return sessions.select("project", "cwd").distinct()


def browse(sessions: DataFrame, limit: int = 20, first_day: str | None = None, last_day: str | None = None, tz: str = "UTC") -> DataFrame:
    """The top-level sessions of latest activity; days are local dates in tz."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds(F.col("last_ts").cast("long")), tz)).cast("string")
    s = sessions.where(~F.col("is_subagent"))
    s = s.where(day >= first_day) if first_day else s
    s = s.where(day <= last_day) if last_day else s
    return s.orderBy(F.desc("last_ts"), "id").limit(limit)


def live_sessions(sessions: DataFrame, now: float, limit: int = 20) -> DataFrame:
    """The most recently active sessions with their age in seconds, never negative."""
    return sessions.orderBy(F.desc("last_ts"), "id").limit(limit).select("id", "project", "message_count", F.greatest(F.lit(0.0), now - F.col("last_ts")).alias("age"))


def session_tail(messages: DataFrame, sessions: DataFrame, n: int = 5, now: float | None = None) -> DataFrame:
    """The last n messages of each of the sessions (session_id), with the session's total and,
    given the time now, the age of its newest message in seconds, never negative."""
    w, whole = Window.partitionBy("session_id").orderBy(F.desc("id")), Window.partitionBy("session_id")
    m = messages.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    age = [] if now is None else [F.greatest(F.lit(0.0), now - F.col("_last")).alias("age")]
    rows = m.withColumn("back", F.row_number().over(w)).withColumn("total", F.count("*").over(whole)).withColumn("_last", F.max("ts").over(whole))
    return rows.where(F.col("back") <= n).select("session_id", "id", "role", "back", "total", *age)


def lineage_root(sessions: DataFrame) -> DataFrame:
    """id, root: parents are followed HOPS times at most; a parent that is not there is the root
    itself; in a cycle the smallest id is. Steps double each round, whose result is written, so a
    round is one join; rounds end when no session has moved."""
    links = written(sessions.select("id", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id")).alias("up")), "links")
    step = links.select("id", F.coalesce("up", "id").alias("at"), F.least("id", F.coalesce("up", "id")).alias("low"))
    for _ in range(HOPS.bit_length() - 1):
        onward = step.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("low").alias("_low"))
        moved = step.join(onward, F.col("at") == F.col("_id"), "left").select("id", F.coalesce("_at", "at").alias("at"), F.least("low", F.coalesce("_low", "low")).alias("low"), (F.coalesce("_at", "at") != F.col("at")).alias("moved"))
        step = written(moved, "lineage")
        if not step.where("moved").limit(1).count():
            break
    ends = links.select(F.col("id").alias("_id"), F.col("up").isNotNull().alias("goes_on"))
    return step.join(ends, F.col("at") == F.col("_id"), "left").select("id", F.when(F.coalesce("goes_on", F.lit(False)), F.col("low")).otherwise(F.col("at")).alias("root"))


def subagents(sessions: DataFrame) -> DataFrame:
    """parent, child: subagents by their parent_id, or by an id that starts with the parent's."""
    subs = sessions.where("is_subagent")
    by_link = subs.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("parent"), F.col("id").alias("child"))
    by_name = subs.where(F.contains("id", F.lit("/"))).select(F.split_part("id", F.lit("/"), F.lit(1)).alias("parent"), F.col("id").alias("child"))
    return by_link.union(by_name).distinct()


def derive_title(messages: DataFrame, native: DataFrame | None = None) -> DataFrame:
    """session_id, title: a native title (session_id, title) if there is one, else the first
    substantive user text; one line, 80 characters."""
    clean = X.strip_generated(F.col("content"))
    first = messages.where((F.col("role") == "user") & ~X.is_low_signal(clean)).groupBy("session_id").agg(F.min_by(clean, "id").alias("own"))
    rows = messages.select("session_id").distinct().join(first, "session_id", "left")
    if native is None:
        return rows.select("session_id", F.left("own", F.lit(X.TITLE_CAP)).alias("title"))
    return rows.join(native, "session_id", "left").select("session_id", F.left(F.coalesce(F.nullif("title", F.lit("")), "own"), F.lit(X.TITLE_CAP)).alias("title"))


def session_preview(messages: DataFrame, look: int = 8, cap: int = 70) -> DataFrame:
    """The first substantive of the first user texts, else the first of them."""
    clean = messages.where("role = 'user'").withColumn("clean", X.strip_generated(F.col("content"))).where("clean <> ''")
    rows = clean.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("id"))).where(F.col("n") <= look)
    good = F.when(~X.is_low_signal(F.col("clean")), F.col("id"))
    per = rows.groupBy("session_id").agg(F.min_by("clean", good).alias("best"), F.min_by("clean", "id").alias("first"))
    return per.select("session_id", F.left(F.coalesce("best", "first"), F.lit(cap)).alias("preview"))


def last_activity(messages: DataFrame, look: int = 40, cap: int = 70) -> DataFrame:
    """The newest displayable text of the last messages, else the empty text."""
    full = messages.where(F.trim("content") != "")
    rows = full.withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))).where(F.col("back") <= look)
    shown = F.when(X.is_displayable(F.col("content")), F.col("id"))
    per = rows.groupBy("session_id").agg(F.max_by(X.strip_generated(F.col("content")), shown).alias("text"))
    return per.select("session_id", F.left(F.coalesce("text", F.lit("")), F.lit(cap)).alias("activity"))


def anchored_window(messages: DataFrame, anchors: DataFrame, n: int = 3, cap: int = 200, around: int = 0, more: int = 0) -> DataFrame:
    """Rows of each anchor (ref_id, session_id, id) within n of it, by place in the session, with
    the rows before and after; around shifts the centre, more widens to (more + 1) * 8. Only
    user and assistant rows and the anchor are shown; all but the anchor are cut at cap. Anchors
    are turned into the places they ask for, so that a session's rows meet these alone."""
    width = (more + 1) * 8 if more else n
    w = Window.partitionBy("session_id").orderBy("id")
    placed = messages.withColumn("rn", F.row_number().over(w)).withColumn("size", F.count("*").over(Window.partitionBy("session_id")))
    at = anchors.join(placed.select("session_id", "id", (F.col("rn") + around).alias("centre")), ["session_id", "id"]).select("ref_id", "session_id", F.col("id").alias("anchor"), "centre")
    wanted = at.withColumn("rn", F.explode(F.sequence(F.col("centre") - width, F.col("centre") + width)))
    rows = placed.join(wanted, ["session_id", "rn"])
    is_anchor = F.col("id") == F.col("anchor")
    shown = rows.where(is_anchor | F.col("role").isin("user", "assistant"))
    body = F.when(is_anchor, F.col("content")).otherwise(F.left("content", F.lit(cap)))
    return shown.select("ref_id", "session_id", "id", "role", body.alias("text"), is_anchor.alias("is_anchor"), (F.col("rn") - F.col("centre")).alias("ord"), F.greatest(F.lit(0), F.col("centre") - width - 1).alias("before"), F.greatest(F.lit(0), F.col("size") - F.col("centre") - width).alias("after"))


def bookends(messages: DataFrame, k: int = 4, scan: int = 40) -> DataFrame:
    """section (start or end), ord: each session's first and last displayable rows of user and
    assistant among its first and last rows; a row at both ends is at the start only."""
    talk = messages.where(F.col("role").isin("user", "assistant"))
    parts = []
    for section, order in (("start", F.col("id").asc()), ("end", F.col("id").desc())):
        w = Window.partitionBy("session_id").orderBy(order)
        seen = talk.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= scan).where(X.is_displayable(F.col("content")))
        parts.append(seen.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k).select("session_id", F.lit(section).alias("section"), "ord", "id"))
    start, end = parts
    return start.union(end.join(start.select("session_id", "id"), ["session_id", "id"], "left_anti").select("session_id", "section", "ord", "id"))


def apply_budget(rows: DataFrame, budget: int, marker: str = " …[truncated]") -> DataFrame:
    """Rows (ref_id, ord, text) within a budget of characters: the one that overflows is cut, the
    rest are dropped; used counts the marker too."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("ref_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.col("_before") + F.length("text") > budget
    body = F.when(cut, F.concat(F.left("text", F.lit(budget) - F.col("_before")), F.lit(marker))).otherwise(F.col("text"))
    kept = rows.withColumn("_before", before).where(F.col("_before") < budget)
    return kept.withColumn("truncated", cut).withColumn("text", body).withColumn("used", F.col("_before") + F.length("text")).drop("_before")


def outline(messages: DataFrame, segments: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, n_start, n_end, n_middle (messages strictly between), n_topics, n_subagents."""
    ends = bookends(messages).groupBy("session_id").agg(F.count_if(F.col("section") == "start").alias("n_start"), F.count_if(F.col("section") == "end").alias("n_end"), F.max(F.when(F.col("section") == "start", F.col("id"))).alias("lo"), F.min(F.when(F.col("section") == "end", F.col("id"))).alias("hi"))
    middle = messages.join(ends, "session_id").groupBy("session_id", "n_start", "n_end").agg(F.count_if((F.col("id") > F.col("lo")) & (F.col("id") < F.col("hi"))).alias("n_middle"))
    topics = segments.groupBy("session_id").agg(F.count("*").alias("n_topics"))
    subs = subagents(sessions).groupBy(F.col("parent").alias("session_id")).agg(F.count("*").alias("n_subagents"))
    full = middle.join(topics, "session_id", "left").join(subs, "session_id", "left")
    return full.select("session_id", "n_start", "n_end", "n_middle", F.coalesce("n_topics", F.lit(0)).alias("n_topics"), F.coalesce("n_subagents", F.lit(0)).alias("n_subagents"))


def parse_refs(refs: DataFrame) -> DataFrame:
    """ref_id, session_ref, uuid_ref, status of references like session:uuid."""
    ref = F.regexp_replace(F.trim("ref"), "^ref=", "")
    s, u = F.split_part(ref, F.lit(":"), F.lit(1)), F.split_part(ref, F.lit(":"), F.lit(2))
    status = F.when(~F.contains(ref, F.lit(":")), "invalid").when(u.rlike("^[0-9]{1,7}$"), "legacy").when((s == "") | ~F.lower(u).rlike("^[0-9a-f-]{1,36}$"), "invalid").otherwise("ok")
    return refs.select("ref_id", s.alias("session_ref"), F.lower(u).alias("uuid_ref"), status.alias("status"))


def resolve_refs(refs: DataFrame, sessions: DataFrame, messages: DataFrame, prefix: int = 8) -> DataFrame:
    """ref_id, session_id, id, status: ok, not_found, ambiguous, or as parsed. Prefixes of any
    length join by equality. Top-level sessions come first: subagents count only where no
    top-level session matches. Sessions without the column is_subagent are all top-level."""
    if "is_subagent" not in sessions.columns:
        sessions = sessions.withColumn("is_subagent", F.lit(False))
    parsed = parse_refs(refs)
    good = parsed.where("status = 'ok'")
    lengths = good.agg(F.collect_set(F.length("session_ref")).alias("lengths"))  # one row
    keys = F.explode(F.array_distinct(F.transform("lengths", lambda n: F.left("id", n))))
    found = good.join(sessions.select("id", "is_subagent").join(F.broadcast(lengths)).select("id", "is_subagent", keys.alias("session_ref")), "session_ref", "left")
    top = F.when(~F.col("is_subagent"), F.col("id"))
    per = found.groupBy("ref_id", "session_ref", "uuid_ref").agg(F.when(F.count(top) > 0, F.count(top)).otherwise(F.count("id")).alias("n"), F.coalesce(F.min(top), F.min("id")).alias("session_id"))
    rows = per.where("n = 1").join(messages.select("session_id", F.col("id").alias("mid"), "uuid"), "session_id", "left")
    hit = F.when(F.startswith("uuid", "uuid_ref"), F.col("mid"))
    located = rows.groupBy("ref_id", "session_id").agg(F.count(hit).alias("k"), F.min(hit).alias("id"))
    done = located.select("ref_id", "session_id", F.when(F.col("k") == 1, F.col("id")).alias("id"), F.when(F.col("k") == 1, "ok").when(F.col("k") == 0, "not_found").otherwise("ambiguous").alias("status"))
    none = F.lit(None)
    unclear = per.where("n <> 1").select("ref_id", none.cast("string").alias("session_id"), none.cast("long").alias("id"), F.when(F.col("n") == 0, "not_found").otherwise("ambiguous").alias("status"))
    bad = parsed.where("status <> 'ok'").select("ref_id", none.cast("string").alias("session_id"), none.cast("long").alias("id"), "status")
    return done.union(unclear).union(bad)


def read_refs(refs: DataFrame, sessions: DataFrame, messages: DataFrame, n: int = 3, budget: int = 2000) -> DataFrame:
    """The window around every resolved reference, within a budget of characters."""
    found = resolve_refs(refs, sessions, messages).where("status = 'ok'").select("ref_id", "session_id", "id")
    return apply_budget(anchored_window(messages, found, n), budget).select("ref_id", "session_id", "id", "ord", "is_anchor", "truncated", "used", "before", "after")


def read_full(refs: DataFrame, sessions: DataFrame, messages: DataFrame, n: int = 3, budget: int = 2000, around: int = 0, more: int = 0, ends: int = 2, needles: DataFrame | None = None) -> DataFrame:
    """ref_id, section (start, window, end or focus), ord, id, text, n_subagents: all that a
    reader of resolved references sees. Bookends are rows of the session outside the window;
    focus is the text around the first window row that holds the reference's needle."""
    found = resolve_refs(refs, sessions, messages).where("status = 'ok'").select("ref_id", "session_id", "id")
    shown = apply_budget(anchored_window(messages, found, n, around=around, more=more), budget)
    window = shown.select("ref_id", F.lit("window").alias("section"), "ord", "id", "text")
    edges = found.select("ref_id", "session_id").join(bookends(messages, ends), "session_id").join(shown.select("ref_id", "id"), ["ref_id", "id"], "left_anti")
    text = F.left(X.strip_generated(F.col("content")), F.lit(200))
    edges = edges.join(messages.select("id", text.alias("text")), "id").select("ref_id", "section", "ord", "id", "text")
    rows = window.unionByName(edges)
    if needles is not None:
        focus = focus_snippet(shown, needles)
        rows = rows.unionByName(focus.select("ref_id", F.lit("focus").alias("section"), F.lit(0).alias("ord"), F.lit(None).cast("long").alias("id"), F.col("focus").alias("text")))
    subs = subagents(sessions).groupBy(F.col("parent").alias("session_id")).agg(F.count("*").alias("n_subagents"))
    counts = found.join(subs, "session_id", "left").select("ref_id", F.coalesce("n_subagents", F.lit(0)).alias("n_subagents"))
    return rows.join(counts, "ref_id").select("ref_id", "section", "ord", "id", "text", "n_subagents")


def focus_snippet(rows: DataFrame, needles: DataFrame, before: int = 60, after: int = 120) -> DataFrame:
    """ref_id and, around the first row that contains its needle (ref_id, needle), that text."""
    at = F.position("needle", F.lower("text"))
    first = rows.join(needles.withColumn("needle", F.lower("needle")), "ref_id").withColumn("_at", at).where("_at > 0").groupBy("ref_id", "needle").agg(F.min(F.struct("ord", "text", "_at")).alias("r"))
    start = F.greatest(F.col("r._at") - before, F.lit(1))
    window = F.substr("r.text", start, F.col("r._at") + after - start)
    return first.select("ref_id", X.collapse(F.regexp_replace(window, F.concat(F.lit("(?i)("), X.quoted(F.col("needle")), F.lit(")")), F.lit(">>>$1<<<"))).alias("focus"))


def containing(session: Column, other: Column) -> Column:
    """Whether other is session or a child of it by name."""
    return (other == session) | F.startswith(other, F.concat(session, F.lit("/")))
