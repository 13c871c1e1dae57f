"""Search over tables of queries: terms, BM25, phrases, prefixes, boolean clauses, substrings.

All queries of a table are answered in one job. Statistics are of the whole corpus; filters
only remove rows afterwards. Scores are rounded to nine decimals and ties end in the id.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import held
from . import matching as Q
from .index import WordIndex, as_index
from .stemming import porter
from .substrings import GramIndex, probes_of, substring_search

#: Rows of query terms that are broadcast; larger query tables are joined by shuffle.
BROADCAST_TERMS = 100_000


def small(frame: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """frame with a broadcast hint if it has few rows (it is counted)."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def local(frame: DataFrame, most: int = 5_000) -> tuple[DataFrame, bool]:
    """frame as a table that the plan holds, if it has few rows, so that it is read once; and
    whether it has."""
    rows = frame.limit(most + 1).collect()
    return (held(frame.sparkSession, rows, frame.schema), True) if len(rows) <= most else (frame, False)


def query_terms(queries: DataFrame, stopwords: bool = True) -> DataFrame:
    """query_id, term, is_phrase, pos (see matching.plain_terms). Queries without any term give no rows."""
    rows = queries.select("query_id", F.posexplode(Q.plain_terms(F.col("text"), stopwords)).alias("pos", "t"))
    return rows.select("query_id", "t.term", "t.is_phrase", "pos")


def tokenize(docs: DataFrame, stem: str | None = None, id_column: str = "id", text: str = "content") -> DataFrame:
    """id, pos, term: one row a word. With stem='porter' terms are stemmed; only distinct words
    go through Python."""
    rows = docs.select(F.col(id_column).alias("id"), F.posexplode(X.tokens(F.col(text))).alias("pos", "term"))
    if stem is None:
        return rows
    stems = rows.select("term").distinct().select(F.col("term").alias("word"), porter("term").alias("stem"))
    return rows.join(stems, F.col("term") == F.col("word")).select("id", "pos", F.col("stem").alias("term"))


def with_tokens(docs: DataFrame, id_column: str = "id", text: str = "content") -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), X.tokens(F.col(text)).alias("tokens"))


def term_stats(docs: DataFrame, id_column: str = "id", text: str = "content") -> DataFrame:
    """term, df."""
    rows = docs.select(F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(docs: DataFrame, text: str = "content") -> DataFrame:
    """One row: n_docs, avg_len."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(X.n_tokens(F.col(text))).alias("avg_len"))


def bm25(docs: DataFrame | WordIndex, terms: DataFrame, id_column: str = "id", text: str = "content") -> DataFrame:
    """query_id, id, score from terms (query_id, term): words, and phrases where their words are
    adjacent. Of a stored index only the postings of the terms are read; without one the texts
    are indexed on the way."""
    index = as_index(docs, id_column, text)
    return Q.matches(index, Q.Asked.plain(terms, index.stem))[0]


def matches(docs: DataFrame | WordIndex, queries: DataFrame, id_column: str = "id", text: str = "content") -> DataFrame:
    """query_id, id, score of the texts that answer a query: any term of a plain one; what meets
    the clauses of a boolean one, scored by the items that it does not exclude."""
    index = as_index(docs, id_column, text)
    return Q.matches(index, Q.Asked.of(queries, index.stem))[0]


def phrase_search(docs: DataFrame | WordIndex, terms: DataFrame, id_column: str = "id", text: str = "content") -> DataFrame:
    """query_id, id, term of phrases (any terms of one word or more) whose words are adjacent."""
    index = as_index(docs, id_column, text)
    items = Q.with_items(terms.select("query_id", "term").distinct(), index.stem)
    return Q.item_hits(index, items).select("item", "id").join(items.select("query_id", "term", "item"), "item").select("query_id", "id", "term")


def prefix_search(docs: DataFrame | WordIndex, prefixes: DataFrame, id_column: str = "id", text: str = "content") -> DataFrame:
    """query_id, id, n: how many words of a text begin with the query's prefix (query_id, prefix).
    Prefixes meet the distinct terms, each by its own first letters only, and these the postings."""
    p = prefixes.select("query_id", X.fold(F.col("prefix")).alias("prefix"))
    index = as_index(docs, id_column, text)
    lengths = p.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # one row
    fit = F.filter("lengths", lambda n: n <= F.length("term"))
    starts = index.terms.join(F.broadcast(lengths)).select("term", "bucket", F.explode(F.transform(fit, lambda n: F.left("term", n))).alias("prefix"))
    expanded = starts.join(small(p), "prefix").select("query_id", "term", "bucket")
    hits = index.postings.select("term", "id", "bucket", "tf").join(expanded, ["bucket", "term"])
    return hits.groupBy("query_id", "id").agg(F.sum("tf").alias("n"))


def boolean_search(docs: DataFrame | WordIndex, clauses: DataFrame, id_column: str = "id", text: str = "content") -> DataFrame:
    """query_id, id of texts that meet the clauses (as of matching.query_clauses)."""
    index = as_index(docs, id_column, text)
    items = Q.with_items(clauses, index.stem)
    return Q.satisfied(Q.item_hits(index, items), items)


def substring_fallback(docs: DataFrame, queries: DataFrame, answered: DataFrame, id_column: str = "id", text: str = "content", index: GramIndex | None = None) -> DataFrame:
    """query_id, id of texts that contain the text of a query without any answer. Boolean queries
    have none: their operators are the intent."""
    left = probes_of(queries.where(~Q.is_boolean(F.col("text")))).join(answered.select("query_id").distinct(), "query_id", "left_anti")
    return substring_search(docs, left, id_column, text, index)


def scan_search(docs: DataFrame, terms: DataFrame, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """query_id, id, session_id, ts of messages whose human text contains every term. Texts meet a
    query by the rarest trigram of its longest term, and are then held against all terms; only
    queries without any term of three characters meet every text."""
    wanted = terms.where("term <> ''").groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.max_by("term", F.struct(F.length("term"), "term")).alias("probe"))
    m = date_bounds(docs, first_day, last_day).withColumn("low", F.lower(X.strip_generated(F.col("content")))).select("id", "session_id", "ts", "low")
    every = lambda rows: rows.where(F.forall("terms", lambda t: F.contains("low", t))).select("query_id", "id", "session_id", "ts")
    short, few = local(wanted.where("length(probe) < 3"))
    met = substring_search(m, wanted.where("length(probe) >= 3").select("query_id", "probe"), text="low")
    found = every(met.join(wanted, "query_id").join(m, "id"))
    return found if few and not short.limit(1).count() else found.unionByName(every(m.join(F.broadcast(short) if few else short)))


def date_bounds(messages: DataFrame, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Messages whose day, the first ten characters of ts_iso, is within the bounds."""
    day = F.left("ts_iso", F.lit(10))
    keep = F.lit(True)
    if first_day:
        keep = keep & (day >= first_day)
    if last_day:
        keep = keep & (day <= last_day)
    return messages.where(keep)


def scope_filter(messages: DataFrame, sessions: DataFrame, subagents: bool = False, role: str | None = None, least_messages: int = 0, projects: list[str] | None = None, source_tool: str | None = None) -> DataFrame:
    """Messages of the sessions in scope, and of a role."""
    s = sessions.where(F.col("message_count") >= least_messages)
    if not subagents:
        s = s.where(~F.col("is_subagent"))
    if projects is not None:
        s = s.where(F.col("project").isin(projects))
    if source_tool:
        s = s.where(F.col("source_tool") == source_tool)
    m = messages if role is None else messages.where(F.col("role") == role)
    return m.join(s.select(F.col("id").alias("_sid")), F.col("session_id") == F.col("_sid"), "left_semi")


def path_scope(sessions: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Sessions whose cwd matches: patterns are tried once for each distinct (project, cwd)."""
    scopes = sessions.select("project", "cwd").distinct()
    keep = F.lit(True)
    for pattern, wanted in ((include, True), (exclude, False)):
        if pattern:
            hit = F.col("cwd").rlike(pattern) if _is_regex(pattern, sessions.sparkSession) else F.contains("cwd", F.lit(pattern))
            keep = keep & (hit if wanted else ~hit)
    chosen = scopes.where(keep).select(F.col("project").alias("_p"), F.col("cwd").alias("_c"))
    return sessions.join(chosen, F.col("project").eqNullSafe(F.col("_p")) & F.col("cwd").eqNullSafe(F.col("_c")), "left_semi")


def _is_regex(pattern: str, spark: SparkSession) -> bool:
    """Whether Java, which runs the pattern, takes it."""
    from py4j.protocol import Py4JJavaError

    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError:
        return False
    return True


def keyword_search(
    messages: DataFrame, sessions: DataFrame, queries: DataFrame, limit: int = 8, fetch: int | None = None, sort: str = "relevance", subagents: bool = False,
    first_day: str | None = None, last_day: str | None = None, index: WordIndex | None = None, grams: GramIndex | None = None, tools: bool = False,
) -> DataFrame:
    """query_id, id, session_id, uuid, score, bm25_rank, coverage, rank. Statistics are global;
    filters, then the best fetch rows, then only displayable rows that contain a term (with
    tools, in what tools said too), then by coverage (or by time) and bm25. Boolean queries are
    answered by their clauses alone, without coverage; plain ones that find no word try their
    text as a substring. By default four times limit rows are fetched, eight times for several
    terms; with tools as many, and twice as many. With an index of messages, texts are read of
    the best rows only."""
    words_of = as_index(index or messages)
    asked = Q.Asked.of(queries.select("query_id", "text"), words_of.stem)
    few = asked.rows is not None
    scored, unanswered = Q.matches(words_of, asked)
    hits, probes = scored.withColumn("by_word", F.lit(True)), unanswered.where("length(probe) >= 3")
    if not few or probes.limit(1).count():
        hits = hits.unionByName(substring_search(messages, probes, index=grams).withColumn("score", F.lit(0.0)).withColumn("by_word", F.lit(False)))
    many = (F.size("terms") > 1) & ~F.col("boolean")
    factor = F.when(many, 2).otherwise(1) if tools else F.when(many, 8).otherwise(4)
    wanted = asked.queries.select("query_id", "boolean", F.array("probe").alias("probe"), "terms", (F.lit(fetch) if fetch else limit * factor).alias("most"))
    wanted = F.broadcast(wanted) if few else wanted
    scope = scope_filter(date_bounds(messages, first_day, last_day), sessions, subagents).select("id", "session_id", "uuid", "ts")
    order = {"relevance": [F.desc("score"), F.col("id")], "newest": [F.desc("ts"), F.desc("id")], "oldest": [F.col("ts"), F.col("id")]}[sort]
    best = Window.partitionBy("query_id").orderBy(*order)
    rows = hits.join(scope, "id").withColumn("bm25_rank", F.row_number().over(best)).where(F.col("bm25_rank") <= (fetch or 8 * limit)).join(wanted, "query_id").where("bm25_rank <= most")
    rows = messages.select("id", "content").join(F.broadcast(rows) if few else rows, "id")  # of few queries, few rows each
    human = F.col("content") if tools else X.strip_generated(F.col("content"))
    found = X.coverage(human, F.when(F.col("by_word"), F.col("terms")).otherwise(F.col("probe")))
    rows = rows.withColumn("coverage", F.when(F.col("boolean"), F.least(found, F.lit(1))).otherwise(found)).where(X.is_displayable(F.col("content")) & (F.col("coverage") > 0))
    final = Window.partitionBy("query_id").orderBy(*([F.desc("coverage")] if sort == "relevance" else []), F.col("bm25_rank"))
    rows = rows.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit)
    return rows.select("query_id", "id", "session_id", "uuid", "score", "bm25_rank", "coverage", "rank")


def explain_search(hits: DataFrame, queries: DataFrame, sort: str = "relevance") -> DataFrame:
    """hits with how they were ranked: the method, the bm25 ordinal (-1 for hits by substring,
    which have none), and whether time replaced relevance (recency)."""
    n = query_terms(queries.where(~Q.is_boolean(F.col("text")))).groupBy("query_id").agg(F.countDistinct("term").alias("n_terms"))
    method = F.when(F.col("score") == 0, "substring").when(F.col("n_terms") > 1, "coverage+bm25").otherwise("bm25")
    ordinal = F.when(F.col("score") == 0, -1).otherwise(F.col("bm25_rank"))
    return hits.join(small(n), "query_id", "left").select("query_id", "id", method.alias("method"), "coverage", ordinal.alias("bm25_rank"), F.lit(sort != "relevance").alias("recency"), F.col("rank").alias("final_rank"))


def search_all_projects(messages: DataFrame, sessions: DataFrame, queries: DataFrame, index: WordIndex | None = None) -> DataFrame:
    """query_id, project, n_hits, the most recent hit's id and time; by recency within a query."""
    hits = matches(index or messages, queries).join(messages.select("id", "session_id", "ts_iso"), "id").join(sessions.where("NOT is_subagent").select(F.col("id").alias("session_id"), "project"), "session_id")
    best = hits.groupBy("query_id", "project").agg(F.count("*").alias("n_hits"), F.max(F.struct("ts_iso", "id")).alias("m"))
    return best.select("query_id", "project", "n_hits", F.col("m.id").alias("id"), F.col("m.ts_iso").alias("ts_iso"))


def envelope(hits: DataFrame, limit: int) -> DataFrame:
    """hits up to limit, each with its query's total, has_more and the limit to ask for next."""
    total = F.count("*").over(Window.partitionBy("query_id"))
    more = F.col("total") > limit
    return hits.withColumn("total", total).where(F.col("rank") <= limit).withColumn("has_more", more).withColumn("widen_to", F.when(more, F.lit(max(4 * limit, 20))))


def dedup_lineage(hits: DataFrame, roots: DataFrame, sessions: DataFrame) -> DataFrame:
    """The best hit of each (query, project, lineage root); rows without uuid are left out."""
    rows = hits.where("uuid <> ''").join(roots.select(F.col("id").alias("session_id"), "root"), "session_id", "left").join(sessions.select(F.col("id").alias("session_id"), "project"), "session_id", "left")
    best = Window.partitionBy("query_id", "project", "root").orderBy("rank")
    kept = rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def drop_current_turn(hits: DataFrame, messages: DataFrame, callers: DataFrame) -> DataFrame:
    """hits without those of the caller's own current turn (query_id, caller_session): rows of
    that session from its newest human message on. The caller may be named by the first eight
    characters of its session or more; children of a session are never the caller."""
    turns = messages.where(X.is_human_turn(F.col("role"), F.col("content"))).groupBy("session_id").agg(F.max("id").alias("turn_start"))
    named = callers.where(~F.contains("caller_session", F.lit("/"))).select("query_id", "caller_session")
    same = (F.col("session_id") == F.col("caller_session")) | ((F.length("caller_session") >= 8) & F.startswith("session_id", "caller_session") & ~F.contains("session_id", F.lit("/")))
    own = hits.select("query_id", "id", "session_id").join(named, "query_id").where(same).join(turns, "session_id").where("id >= turn_start").select("query_id", "id")
    return hits.join(own, ["query_id", "id"], "left_anti").select(*hits.columns)


def search_warnings(hits: DataFrame, sessions: DataFrame, messages: DataFrame, now: float) -> DataFrame:
    """query_id and codes, in fixed order: recency_skew (newest hit over a day older than the
    corpus), broad_query (20 hits or more), project_spread (two projects or more)."""
    rows = hits.join(messages.select("id", "ts"), "id").join(sessions.select(F.col("id").alias("session_id"), "project"), "session_id")
    per = rows.groupBy("query_id").agg(F.max("ts").alias("newest"), F.count("*").alias("n"), F.countDistinct("project").alias("projects"))
    codes = F.array(F.when(now - F.col("newest") > 86400, "recency_skew"), F.when(F.col("n") >= 20, "broad_query"), F.when(F.col("projects") >= 2, "project_spread"))
    return per.select("query_id", F.array_join(F.filter(codes, lambda c: c.isNotNull()), ",").alias("codes"))


def scope_report(sessions: DataFrame, hits: DataFrame, messages: DataFrame) -> DataFrame:
    """project, n_sessions, status (searched or empty), n_hits, complete (of all projects)."""
    found = hits.join(sessions.select(F.col("id").alias("session_id"), "project"), "session_id").groupBy("project").agg(F.count("*").alias("n_hits"))
    per = sessions.groupBy("project").agg(F.count("*").alias("n_sessions"), F.sum("message_count").alias("m"))
    whole = per.agg(F.coalesce(F.bool_and(F.col("m") > 0), F.lit(True)).alias("complete"))  # one row
    return per.join(found, "project", "left").join(F.broadcast(whole)).select("project", "n_sessions", F.when(F.col("m") > 0, "searched").otherwise("empty").alias("status"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "complete")


_PARTS = re.compile(r"[^\W_]+|[\W_]+")


def _excerpt(text: str, terms: set[str], size: int, fold) -> str | None:
    parts = _PARTS.findall(text)
    at = [k for k, p in enumerate(parts) if p[0] != "_" and p[0].isalnum()]
    words = [fold(parts[k]) for k in at]
    last = max(len(words) - size, 0)
    count: dict[str, int] = {}
    best, start, end = None, 0, 0
    for i in sorted({min(i, last) for i, w in enumerate(words) if w in terms}):  # one window slides over the text
        while end < min(i + size, len(words)):
            count[words[end]] = count.get(words[end], 0) + (words[end] in terms)
            end += 1
        while start < i:
            count[words[start]] -= words[start] in terms
            start += 1
        distinct = sum(count.get(t, 0) > 0 for t in terms)
        if best is None or distinct > best[0]:
            best = (distinct, i)
    if best is None:
        return None
    first, end = best[1], min(best[1] + size, len(words))
    marked = {at[i] for i in range(first, end) if words[i] in terms}
    body = "".join(f">>>{p}<<<" if k in marked else p for k, p in enumerate(parts[at[first] : at[end - 1] + 1], at[first]))
    return ("…" if first else "") + body + ("…" if end < len(words) else "")


def token_snippet(hits: DataFrame, texts: DataFrame, terms: DataFrame, size: int = 16) -> DataFrame:
    """query_id, id, snippet: size words of a hit's text (id, content) around its best match. Of
    the runs of size words that start at a hit word or end at the text's end, the one with most
    distinct terms counts, the first of equal ones; hit words stand in >>> and <<<, and … marks
    what is left out on either side. A window slides over each text once."""
    wanted = terms.select("query_id", F.explode(X.tokens(F.col("term"))).alias("t")).groupBy("query_id").agg(F.collect_set("t").alias("terms"))
    rows = hits.select("query_id", "id").join(small(wanted), "query_id").join(texts.select("id", "content"), "id")
    fold = X.folder()

    @F.pandas_udf("string")
    def cut(contents: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else _excerpt(c, set(t), size, fold) for c, t in zip(contents, terms)], dtype=object)

    return rows.select("query_id", "id", cut("content", "terms").alias("snippet")).where("snippet IS NOT NULL")


def exists_probes(vectors: DataFrame, segments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: has_vectors, has_topics (any segment or verdict), has_real_segments (a segment
    with a topic)."""
    any_row = lambda d, name: d.limit(1).agg((F.count("*") > 0).alias(name))
    topics = segments.select("session_id").limit(1).union(verdicts.select("session_id").limit(1))
    real = segments.where("topic <> ''")
    return any_row(vectors.select(F.lit(1)), "has_vectors").join(any_row(topics, "has_topics")).join(any_row(real.select(F.lit(1)), "has_real_segments"))  # one row each


def project_spread(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """query_id, n_sessions, n_projects and up to five projects."""
    rows = hits.join(sessions.select(F.col("id").alias("session_id"), "project"), "session_id")
    return rows.groupBy("query_id").agg(F.countDistinct("session_id").alias("n_sessions"), F.countDistinct("project").alias("n_projects"), F.array_join(F.slice(F.array_sort(F.collect_set("project")), 1, 5), ",").alias("sample"))
