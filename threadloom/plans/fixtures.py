"""The corpus of conversations as sessions, messages and the tables around them, in Spark and
as common table expressions of the same content for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import stemming
from ..sources.shared import held

START = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(seconds):
    """UTC time text, whatever the session's time zone."""
    at = F.timestamp_add("SECOND", seconds.cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.concat(F.replace(at.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def messages(spark: SparkSession, sf_dir: str, decorated: bool = False) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    seconds = F.lit(START) + F.col("conv_id") * 3600 + F.col("turn") * 60
    content = F.col("text")
    if decorated:
        k = F.col("turn") % 6
        content = (
            F.when(k == 0, content).when(k == 1, F.concat(content, F.lit(' [TOOL:sh] {"cmd": "ls"}'))).when(k == 2, F.concat(F.lit("[TOOL_RESULT] "), content))
            .when(k == 3, F.concat(F.lit("[THINKING] "), content, F.lit(" [SYSTEM] end [THINKING] so\n"), F.left(content, F.lit(9)))).when(k == 4, F.concat(F.lit("<system-reminder>x</system-reminder>"), content))
            .otherwise(F.concat(content, F.lit(" <bash-stdout>tail")))
        )
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("session_id"), "role", content.alias("content"),
        seconds.cast("double").alias("ts"), iso(seconds).alias("ts_iso"), X.mint_uuid(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uuid"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("*").alias("message_count"))
    conv, sub = F.col("conv_id"), (F.col("conv_id") % 5).isin(3, 4)
    project, third = F.concat(F.lit("p"), (conv % 7).cast("string")), (conv % 3).cast("int")
    at = lambda turn: (F.lit(START) + conv * 3600 + F.col(turn) * 60).cast("double")
    return c.select(
        F.lpad(conv.cast("string"), 8, "0").alias("id"), at("lo").alias("started_at"), at("hi").alias("last_ts"), "message_count", sub.alias("is_subagent"),
        F.when(sub, F.lpad((conv - 1).cast("string"), 8, "0")).alias("parent_id"), project.alias("project"), F.concat(F.lit("/work/"), project).alias("cwd"),
        F.element_at(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), third + 1).alias("source_tool"), F.concat(F.lit("m"), third.cast("string")).alias("origin_machine"),
        F.when(conv % 11 == 0, F.lit(1.7e9)).alias("missing_since"),
    )


def second_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of another machine: the even sessions with other ids, and a row more in each."""
    m = messages(spark, sf_dir).where("CAST(session_id AS bigint) % 2 = 0").withColumn("id", F.col("id") + 500_000_000)
    more = m.groupBy("session_id").agg(F.max("id").alias("id"), F.max("ts").alias("ts"))
    more = more.select((F.col("id") + 1).alias("id"), "session_id", F.lit("user").alias("role"), F.lit("one more").alias("content"), (F.col("ts") + 60).alias("ts"), iso(F.col("ts") + 60).alias("ts_iso"), X.mint_uuid("session_id", F.lit("extra")).alias("uuid"))
    return m.unionByName(more)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topic segments a session, from turns 0 and 3."""
    m = messages(spark, sf_dir).withColumn("turn", F.col("id") % 1000).where("turn IN (0, 3)")
    machine = F.concat(F.lit("m"), (F.col("session_id").cast("long") % 3).cast("string"))
    return m.select("session_id", F.col("uuid").alias("start_uuid"), F.element_at(X.tokens(F.col("content")), 1).alias("topic"), F.left("content", F.lit(40)).alias("summary"), F.col("ts").alias("tagged_at"), machine.alias("origin_machine"), F.col("id").alias("start_id"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").where("quality = 0")
    return l.select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("session_id"), F.lit("routine").alias("verdict"), F.lit("floor").alias("source"), (F.col("doc_id") % 100).cast("double").alias("tagged_at"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("origin_machine"))


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).where("CAST(id AS bigint) % 13 = 0").select(F.col("id").alias("session_id"))


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir)
    return s.select(F.concat(F.lit("/t/"), "id", F.lit(".jsonl")).alias("path"), F.col("last_ts").alias("mtime"), (F.col("message_count") * 100).alias("size"), X.content_hash(F.col("id")).alias("fp"), F.col("id").alias("session_id"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files now on disk: every fourth changed, every ninth gone."""
    n = F.col("session_id").cast("long")
    f = file_index(spark, sf_dir).where(n % 9 != 0)
    return f.select("path", F.when(n % 4 == 0, F.col("mtime") + 5).otherwise(F.col("mtime")).alias("mtime"), F.when(n % 4 == 0, F.col("size") + 7).otherwise(F.col("size")).alias("size"), "fp")


#: The query table: plain, quoted, negated, and a probe inside words.
QUERIES = [(1, "the trash of idiot"), (2, '"of the"'), (3, "stupid NOT clown"), (4, "loser pathetic"), (5, "worthless"), (6, "scum && moron"), (7, "disgusting || idiot"), (8, "hthnd"), (9, "and !trash"),
           (10, "thth thre"), (11, "bleha anedat tion"), (12, "thou && thwh"), (13, "ernt NOT onti"), (14, "erth || einst"), (15, "erin \"of the\" from"), (16, "anlyer"),
           (17, "thou || thwh && !erin"), (18, '"of the" && !trash'), (19, 'pathetic "scum moron'), (20, "disgusting NOT clown NOT moron"), (21, "hthnd && zzz")]


def queries(spark: SparkSession) -> DataFrame:
    return held(spark, QUERIES, "query_id int, text string")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries in every form, made of the first three words of each message."""
    w = X.tokens(F.col("content"))
    rows = messages(spark, sf_dir).select("id", w.alias("w")).where(F.size("w") >= 3).select("id", *[F.element_at("w", i + 1).alias(f"w{i}") for i in range(3)])
    kind = (F.col("id") % 1000 + F.floor(F.col("id") / 1000)) % 7
    text = (
        F.when(kind == 0, F.format_string("%s %s", "w0", "w1")).when(kind == 1, F.format_string('"%s %s" %s', "w0", "w1", "w2")).when(kind == 2, F.format_string("%s NOT %s", "w0", "w1"))
        .when(kind == 3, F.format_string("%s && !%s", "w0", "w2")).when(kind == 4, F.format_string("%s || %s", "w0", "w1")).when(kind == 5, F.format_string('%s "%s %s', "w0", "w1", "w2")).otherwise(F.format_string("%s/%s AND %s", "w0", "w1", "w2"))
    )
    return rows.select(F.col("id").alias("query_id"), text.alias("text"))


ASKED = """asked AS (SELECT id AS query_id, CASE (id % 1000 + id // 1000) % 7 WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN '"' || w[1] || ' ' || w[2] || '" ' || w[3] WHEN 2 THEN w[1] || ' NOT ' || w[2]
 WHEN 3 THEN w[1] || ' && !' || w[3] WHEN 4 THEN w[1] || ' || ' || w[2] WHEN 5 THEN w[1] || ' "' || w[2] || ' ' || w[3] ELSE w[1] || '/' || w[2] || ' AND ' || w[3] END AS text
 FROM (SELECT id, regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+') AS w FROM messages) WHERE len(w) >= 3)"""


def base_sql() -> str:
    """Common table expressions of the same tables."""
    start = f"({START} + conv_id * 3600 + turn * 60)"
    iso_sql = lambda s: f"strftime(make_timestamp(CAST({s} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
    deco = """CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN text || ' [TOOL:sh] {"cmd": "ls"}' WHEN 2 THEN '[TOOL_RESULT] ' || text
      WHEN 3 THEN '[THINKING] ' || text || ' [SYSTEM] end [THINKING] so' || chr(10) || left(text, 9) WHEN 4 THEN '<system-reminder>x</system-reminder>' || text ELSE text || ' <bash-stdout>tail' END"""
    cols = lambda content: f"""SELECT conv_id * 1000 + turn AS id, lpad(CAST(conv_id AS VARCHAR), 8, '0') AS session_id, role, {content} AS content,
      CAST({start} AS DOUBLE) AS ts, {iso_sql(start)} AS ts_iso, left(sha1(concat(conv_id, ':', turn)), 16) AS uuid FROM conversations"""  # noqa: E731
    values = ", ".join(f"({i}, '{t}')" for i, t in QUERIES)
    return f"""WITH RECURSIVE messages AS ({cols("text")}),
deco AS ({cols(deco)}),
sessions AS (SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') AS id, CAST({START} + conv_id * 3600 + min(turn) * 60 AS DOUBLE) AS started_at,
  CAST({START} + conv_id * 3600 + max(turn) * 60 AS DOUBLE) AS last_ts, count(*) AS message_count, conv_id % 5 IN (3, 4) AS is_subagent,
  CASE WHEN conv_id % 5 IN (3, 4) THEN lpad(CAST(conv_id - 1 AS VARCHAR), 8, '0') END AS parent_id, 'p' || (conv_id % 7) AS project, '/work/p' || (conv_id % 7) AS cwd,
  CASE conv_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source_tool, 'm' || (conv_id % 3) AS origin_machine,
  CASE WHEN conv_id % 11 = 0 THEN CAST(1.7e9 AS DOUBLE) END AS missing_since FROM conversations GROUP BY conv_id),
second_0 AS (SELECT id + 500000000 AS id, session_id, role, content, ts, ts_iso, uuid FROM messages WHERE CAST(session_id AS BIGINT) % 2 = 0),
second AS (SELECT * FROM second_0 UNION ALL SELECT max(id) + 1, session_id, 'user', 'one more', max(ts) + 60, {iso_sql("max(ts) + 60")}, left(sha1(session_id || ':extra'), 16) FROM second_0 GROUP BY session_id),
segments AS (SELECT session_id, uuid AS start_uuid, regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}]+')[1] AS topic, left(content, 40) AS summary, ts AS tagged_at,
  'm' || (CAST(session_id AS BIGINT) % 3) AS origin_machine, id AS start_id FROM messages WHERE id % 1000 IN (0, 3)),
verdicts AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS session_id, 'routine' AS verdict, 'floor' AS source, CAST(doc_id % 100 AS DOUBLE) AS tagged_at, 'm' || (doc_id % 3) AS origin_machine FROM labels WHERE quality = 0),
tombstones AS (SELECT id AS session_id FROM sessions WHERE CAST(id AS BIGINT) % 13 = 0),
file_index AS (SELECT '/t/' || id || '.jsonl' AS path, last_ts AS mtime, message_count * 100 AS size, left(sha1(id), 16) AS fp, id AS session_id FROM sessions),
listing AS (SELECT path, CASE WHEN CAST(session_id AS BIGINT) % 4 = 0 THEN mtime + 5 ELSE mtime END AS mtime, CASE WHEN CAST(session_id AS BIGINT) % 4 = 0 THEN size + 7 ELSE size END AS size, fp
  FROM file_index WHERE CAST(session_id AS BIGINT) % 9 <> 0),
queries(query_id, text) AS (VALUES {values})"""


def clean_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def tools_sql(c: str) -> str:
    marked = f"regexp_replace({c}, '(\\s\\[[A-Z])', chr(1) || '\\1', 'g')"
    return f"replace(regexp_replace({marked}, '\\[TOOL(_RESULT)?[:\\]][^\\x01]*', '', 'g'), chr(1), '')"


def envelopes_sql(c: str) -> str:
    for tag in X.ENVELOPES:
        c = f"regexp_replace({c}, '<{tag}([ \\t\\n\\r][^>]*)?>.*?(</{tag}>|\\z)', '', 'gs')"
    return c


def thinking_runs_sql(c: str) -> str:
    marked = f"regexp_replace({c}, '(\\s\\[[A-Z]|\\n[^ \\t])', chr(1) || '\\1', 'g')"
    return f"replace(regexp_replace({marked}, '\\[THINKING[:\\]][^\\x01]*', '', 'g'), chr(1), '')"


def thinking_sql(c: str) -> str:
    return clean_sql(thinking_runs_sql(c))


def generated_sql(c: str) -> str:
    return clean_sql(envelopes_sql(tools_sql(c)))


def displayable_sql(c: str) -> str:
    g = generated_sql(c)
    return f"({g} <> '' AND NOT starts_with(ltrim({c}), '{X.INTERRUPTED}') AND {g} NOT IN ('[THINKING]', '[SYSTEM]', '[TOOL_RESULT]') AND NOT regexp_matches({g}, '^\\[TOOL:[^\\]]*\\]$'))"


def low_signal_sql(c: str) -> str:
    t = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    names = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return f"({t} = '' OR lower({t}) IN ({names(X.GREETINGS)}) OR regexp_extract(lower({t}), '^(/\\S*)', 1) IN ({names(X.SLASH_COMMANDS)}) OR left({t}, 1) IN ('{{', '[', '<'))"


def human_sql(role: str, c: str) -> str:
    return f"({role} = 'user' AND length(trim({c})) > 2 AND " + " AND ".join(f"NOT starts_with({c}, '{p}')" for p in X.NOT_TYPED) + ")"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"


def porter_sql(words: str) -> str:
    """CTEs that end in stems (word, stem) of a query of words, by patterns of vowels and consonants."""
    con, vow = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    some = lambda w: f"regexp_matches({w}, '^({con})?{vow}{con}')"
    one = lambda w: f"regexp_matches({w}, '^({con})?{vow}{con}({vow})?$')"
    more = lambda w: f"regexp_matches({w}, '^({con})?{vow}{con}{vow}{con}')"
    vowel = lambda w: f"regexp_matches({w}, '^({con})?[aeiouy]')"
    short = lambda w: f"regexp_matches({w}, '^{con}[aeiouy][^aeiouwxy]$')"
    cut = lambda n: f"left(w, len(w) - {n})"

    def suffixes(table: dict[str, str]) -> str:
        found = sorted(table, key=len, reverse=True)
        return "CASE " + " ".join(f"WHEN ends_with(w, '{x}') THEN CASE WHEN {some(cut(len(x)))} THEN {cut(len(x))} || '{table[x]}' ELSE w END" for x in found) + " ELSE w END"

    fourth = "CASE " + " ".join(
        f"WHEN ends_with(w, '{x}') THEN CASE WHEN {more(cut(len(x)))}" + (f" AND right({cut(len(x))}, 1) IN ('s', 't')" if x == "ion" else "") + f" THEN {cut(len(x))} ELSE w END" for x in sorted(stemming._STEP4, key=len, reverse=True)
    ) + " ELSE w END"
    return f"""p0 AS (SELECT word, regexp_replace(word, '^y', 'Y') AS w FROM ({words}) WHERE regexp_full_match(word, '[a-z]{{3,64}}')),
p1 AS (SELECT word, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END AS w FROM p0),
p2 AS (SELECT word, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {some(cut(3))} THEN {cut(1)} ELSE w END WHEN ends_with(w, 'ed') AND {vowel(cut(2))} THEN {cut(2)} WHEN ends_with(w, 'ing') AND {vowel(cut(3))} THEN {cut(3)} ELSE w END AS w,
  NOT ends_with(w, 'eed') AND (ends_with(w, 'ed') AND {vowel(cut(2))} OR ends_with(w, 'ing') AND {vowel(cut(3))}) AS again FROM p1),
p3 AS (SELECT word, CASE WHEN NOT again THEN w WHEN right(w, 2) IN ('at', 'bl', 'iz') THEN w || 'e' WHEN len(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(w, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z') THEN {cut(1)} WHEN {one('w')} AND {short('w')} THEN w || 'e' ELSE w END AS w FROM p2),
p4 AS (SELECT word, CASE WHEN ends_with(w, 'y') AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE w END AS w FROM p3),
p5 AS (SELECT word, {suffixes(stemming._STEP2)} AS w FROM p4),
p6 AS (SELECT word, {suffixes(stemming._STEP3)} AS w FROM p5),
p7 AS (SELECT word, {fourth} AS w FROM p6),
p8 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND ({more(cut(1))} OR {one(cut(1))} AND NOT {short(cut(1))}) THEN {cut(1)} ELSE w END AS w FROM p7),
p9 AS (SELECT word, CASE WHEN ends_with(w, 'll') AND {more(cut(1))} THEN {cut(1)} ELSE w END AS w FROM p8),
stems AS (SELECT word, lower(w) AS stem FROM p9)"""
