"""Named queries of the readers, writers and streams, over raw lines that Spark derives from the
conversations, with the same result as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import merging as M
from ..operators import vectors as V
from ..sources import registry
from ..sources import transcripts as R
from ..sources.shared import shared_path as shared
from ..sources.store import SessionStore
from ..streaming import streams
from . import fixtures as D
from .catalog import hashed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{D.base_sql()}\n{sql}"
        return f

    return add


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Block records, one a message; every seventh line is broken, every eleventh of another type."""
    m = R.to_block_jsonl(D.messages(spark, sf))
    raw = F.when(F.col("id") % 7 == 0, F.lit("{broken")).when(F.col("id") % 11 == 0, F.lit('{"type": "other"}')).otherwise(F.col("value"))
    return R.text_lines(m, F.concat(F.lit("/t/"), "session_id", F.lit(".jsonl")), F.col("id") % 1000, raw)


def tool_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Block records with thinking, tool calls and tool results as text and as a list."""
    m = D.messages(spark, sf)
    told, k = F.to_json(F.col("content").cast("variant")), F.col("id") % 1000 % 5
    part = (
        F.when(k == 0, F.concat(F.lit('{"type": "thinking", "thinking": '), told, F.lit('}, {"type": "text", "text": "so"}')))
        .when(k == 1, F.concat(F.lit('{"type": "tool_use", "name": "sh", "input": {"cmd": '), told, F.lit(', "a": [1, {"z": 2, "b": "x,y:z"}]}}')))
        .when(k == 2, F.concat(F.lit('{"type": "tool_use"}, {"type": "tool_result", "content": '), told, F.lit("}")))
        .when(k == 3, F.concat(F.lit('{"type": "tool_result", "content": [{"type": "text", "text": '), told, F.lit('}, {"type": "image"}, {"text": "second"}]}')))
        .otherwise(F.concat(F.lit('{"type": "text", "text": ""}, {"type": "other"}, {"type": "text", "text": '), told, F.lit("}")))
    )
    raw = F.concat(F.lit('{"type": "assistant", "uuid": "'), "uuid", F.lit('", "message": {"role": "assistant", "content": ['), part, F.lit("]}}"))
    return R.text_lines(m, F.concat(F.lit("/t/"), "session_id", F.lit(".jsonl")), F.col("id") % 1000, raw)


@query("""SELECT session_id, CAST(id % 1000 AS INTEGER) AS line, CASE id % 1000 % 5 WHEN 0 THEN '[THINKING] ' || left(content, 8000) || ' so'
WHEN 1 THEN '[TOOL:sh] ' || left('{"a": [1, {"b": "x,y:z", "z": 2}], "cmd": ' || CAST(to_json(content) AS VARCHAR) || '}', 500) WHEN 2 THEN '[TOOL:?] {} [TOOL_RESULT] ' || left(content, 1000)
WHEN 3 THEN '[TOOL_RESULT] ' || left(content, 1000) || ' [TOOL_RESULT] second' ELSE left(content, 8000) END AS content FROM messages""")
def read_tool_blocks(spark, sf):
    return R.read_block_jsonl(tool_blocks(spark, sf)).select("session_id", "line", "content")


@query("""SELECT session_id, left(trim(regexp_replace(min_by(CASE WHEN id % 2 = 0 THEN content ELSE 'own ' || id END, id), '\\s+', ' ', 'g')), 80) AS title FROM messages WHERE id % 3 = 0 GROUP BY session_id""")
def native_titles(spark, sf):
    m = D.messages(spark, sf)
    record = F.when(F.col("id") % 3 != 0, F.to_json(F.struct(F.lit("user").alias("type"), F.lit(" ").alias("title")))).when(F.col("id") % 2 == 0, F.to_json(F.struct(F.lit("late").alias("title"), F.col("content").alias("summary")))).otherwise(F.to_json(F.struct(F.concat(F.lit("own "), F.col("id").cast("string")).alias("title"))))
    return R.native_titles(R.text_lines(m, F.concat(F.lit("/t/"), "session_id", F.lit(".jsonl")), F.col("id") % 1000, record))


@query("SELECT id AS session_id, cwd, parent_id, is_subagent FROM sessions")
def aliased_sessions(spark, sf):
    s = D.sessions(spark, sf)
    return R.aliased_sessions(s.select(F.col("id").alias("Name"), F.col("cwd").alias("project_path"), F.col("parent_id").alias("Parent_Session_ID"), F.when(F.col("is_subagent"), "1").otherwise("0").alias("is_sub")))


def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """Rollout files: a header, then a message or a tool call for each message."""
    m, s = D.messages(spark, sf), D.sessions(spark, sf)
    path = lambda c: F.concat(F.lit("/r/rollout-"), c, F.lit(".jsonl"))
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct("id", "cwd", F.col("parent_id").alias("parent_thread_id"), F.when(F.col("is_subagent"), "subagent").otherwise("user").alias("thread_source")).alias("payload")))
    call = F.struct(F.lit("function_call").alias("type"), F.lit("sh").alias("name"), F.col("content").alias("arguments"))
    said = F.struct(F.lit("message").alias("type"), F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("content"))
    item = lambda p: F.to_json(F.struct(F.lit("response_item").alias("type"), F.col("ts_iso").alias("timestamp"), p.alias("payload")))
    items = R.text_lines(m, path(F.col("session_id")), F.col("id") % 1000 + 1, F.when(F.col("id") % 3 == 0, item(call)).otherwise(item(said)))
    return items.union(R.text_lines(s, path(F.col("id")), F.lit(0), head))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "USER_INPUT").when(F.col("role") == "assistant", "PLANNER_RESPONSE").otherwise("HISTORY")
    content = F.when(F.col("role") == "user", F.concat(F.lit("<USER_REQUEST>\n"), "content", F.lit("\n</USER_REQUEST>"))).otherwise(F.col("content"))
    record = F.to_json(F.struct((F.col("id") % 1000).alias("step_index"), kind.alias("type"), F.col("ts_iso").alias("created_at"), content.alias("content"), F.concat(F.lit("/work/"), F.right("session_id", F.lit(1))).alias("cwd")))
    return R.text_lines(D.messages(spark, sf), F.concat(F.lit("/steps/"), "session_id", F.lit(".jsonl")), F.col("id") % 1000, record)


@query("SELECT session_id, CAST(id % 1000 AS INTEGER) AS line, role, content, ts, uuid FROM messages WHERE id % 7 <> 0 AND id % 11 <> 0 AND trim(content) <> ''")
def read_block_jsonl(spark, sf):
    return R.read_block_jsonl(blocks(spark, sf)).select("session_id", "line", "role", F.substr("content", F.lit(1)).alias("content"), "ts", "uuid")


@query("SELECT session_id, CAST(id % 1000 AS INTEGER) AS line, role, content FROM messages WHERE id % 7 <> 0 AND id % 11 <> 0 AND trim(content) <> ''")
def extract_text(spark, sf):
    return R.read_block_jsonl(blocks(spark, sf)).select("session_id", "line", "role", "content")


@query("SELECT '/t/' || CASE WHEN is_subagent THEN parent_id || '/subagents/' || id ELSE id END || '.jsonl' AS path, CASE WHEN is_subagent THEN parent_id || '/' || id ELSE id END AS session_id, is_subagent, parent_id FROM sessions")
def containers_from_paths(spark, sf):
    s = D.sessions(spark, sf)
    name = F.when(F.col("is_subagent"), F.concat("parent_id", F.lit("/subagents/"), "id")).otherwise(F.col("id"))
    return R.containers_from_paths(s.select(F.concat(F.lit("/t/"), name, F.lit(".jsonl")).alias("path")))


@query("SELECT '/r/rollout-' || id || '.jsonl' AS path, id AS session_id, cwd, parent_id, is_subagent FROM sessions")
def rollout_containers(spark, sf):
    return R.rollout_containers(rollouts(spark, sf))


@query("SELECT session_id, CAST(id % 1000 + 1 AS INTEGER) AS line, CASE WHEN id % 3 = 0 THEN 'assistant' ELSE role END AS role, CASE WHEN id % 3 = 0 THEN '[TOOL:sh] ' || left(content, 500) ELSE content END AS content, ts FROM messages WHERE trim(content) <> ''")
def normalize_rollout(spark, sf):
    return R.normalize_rollout(rollouts(spark, sf)).select("session_id", "line", "role", "content", "ts")


@query("SELECT session_id, CAST(id % 1000 AS INTEGER) AS line, role, CASE WHEN role = 'user' THEN trim(content) ELSE content END AS content FROM messages WHERE role IN ('user', 'assistant') AND trim(content) <> ''")
def normalize_steplog(spark, sf):
    return R.normalize_steplog(steps(spark, sf)).select("session_id", "line", "role", "content")


@query("SELECT id AS session_id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN cwd ELSE '/work/' || right(id, 1) END AS cwd FROM sessions")
def steplog_containers(spark, sf):
    history = D.sessions(spark, sf).where("CAST(id AS bigint) % 2 = 0").select(F.col("id").alias("conversationId"), F.col("cwd").alias("workspace"))
    return R.steplog_containers(steps(spark, sf), history).select("session_id", "cwd")


@query("SELECT '/steps/' || id || '.jsonl' AS path, '/work/' || right(id, 1) AS cwd FROM sessions")
def first_cwd(spark, sf):
    return R.first_cwd(steps(spark, sf))


@query("SELECT session_id, id AS line, role, content, ts FROM messages WHERE trim(content) <> ''")
def normalize_aliased_table(spark, sf):
    m = D.messages(spark, sf).select(F.col("session_id").alias("thread_id"), F.col("id").alias("seq"), F.col("role").alias("Sender"), F.col("content").alias("Body"), (F.col("ts") * 1000).cast("long").alias("created"))
    return R.normalize_aliased_table(m).select("session_id", "line", "role", "content", "ts")


@query("""SELECT id, '{"a": ' || id || ', "b": {"x": "é", "y": [1, 2]}}' AS value FROM messages""")
def json_dump(spark, sf):
    return D.messages(spark, sf).select("id", R.json_dump(F.concat(F.lit('{"b":{"y":[1,2],"x":"é"},"a":'), F.col("id").cast("string"), F.lit("}"))).alias("value"))


@query("SELECT id, left(sha1(CASE WHEN length(t) > 4096 THEN t[1:4096] || '|' || t[-4096:] ELSE t || '|' || t END), 16) AS fp FROM (SELECT doc_id AS id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t FROM documents)")
def file_fingerprint(spark, sf):
    t = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    return D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.file_fingerprint(t.cast("binary")).alias("fp"))


@query("SELECT session_id, id, role, content FROM messages")
def to_block_jsonl(spark, sf):
    """Messages written as records, read again."""
    rows = R.to_block_jsonl(D.messages(spark, sf)).withColumn("rec", F.parse_json("value"))
    return rows.select("session_id", "id", F.try_variant_get("rec", "$.message.role", "string").alias("role"), F.try_variant_get("rec", "$.message.content[0].text", "string").alias("content"))


@query("""SELECT count(*) FILTER (n > 0) AS sessions, CAST(coalesce(sum(n), 0) AS BIGINT) AS messages, 0 AS missing, count(*) FILTER (n = 0) AS unreadable, (SELECT count(*) FROM tombstones) AS tombstoned
FROM (SELECT session_id, count(*) FILTER (id % 7 <> 0 AND id % 11 <> 0 AND trim(content) <> '') AS n FROM messages WHERE session_id NOT IN (SELECT session_id FROM tombstones) GROUP BY 1)""")
def rebuild_from_vault(spark, sf):
    meta = D.file_index(spark, sf).select("session_id", "path")
    return R.rebuild_from_vault(blocks(spark, sf), meta, D.tombstones(spark, sf))


@query("""SELECT session_id, line, role, content, source FROM (
  SELECT session_id, CAST(id % 1000 AS INTEGER) AS line, role, content, 'blocks' AS source, CAST(session_id AS BIGINT) AS k FROM messages WHERE id % 7 <> 0 AND id % 11 <> 0 AND trim(content) <> ''
  UNION ALL SELECT session_id, CAST(id % 1000 + 1 AS INTEGER), CASE WHEN id % 3 = 0 THEN 'assistant' ELSE role END, CASE WHEN id % 3 = 0 THEN '[TOOL:sh] ' || left(content, 500) ELSE content END, 'rollout', CAST(session_id AS BIGINT) + 1 FROM messages
  UNION ALL SELECT session_id, CAST(id % 1000 AS INTEGER), role, CASE WHEN role = 'user' THEN trim(content) ELSE content END, 'steps', CAST(session_id AS BIGINT) + 2 FROM messages WHERE role IN ('user', 'assistant')) WHERE k % 3 = 0""")
def read_mixed(spark, sf):
    """One folder's lines of three kinds of file, a third of the sessions each; files of a kind that nobody reads are left out."""
    kinds = [(blocks, 0), (rollouts, 2), (steps, 1)]
    stem = F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("long")
    lines = None
    for make, rest in kinds:
        own = make(spark, sf).where(stem % 3 == rest)
        lines = own if lines is None else lines.unionByName(own)
    other = blocks(spark, sf).withColumn("path", F.concat("path", F.lit(".bak")))
    return registry.read_mixed(lines.unionByName(other)).select("session_id", "line", "role", "content", "source")


def stream(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as a stream of the conversations' files."""
    schema = D.table(spark, sf, "conversations").schema
    raw = spark.readStream.schema(schema).load(f"{sf}/conversations.parque[t]")  # a pattern, as the table may be one file
    seconds = F.lit(D.START) + F.col("conv_id") * 3600 + F.col("turn") * 60
    return raw.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("session_id"), "role", F.col("text").alias("content"), seconds.cast("double").alias("ts"), F.timestamp_seconds(seconds).alias("event_time"), X.mint_uuid(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uuid"))


@query("SELECT session_id, uuid FROM messages")
def stream_dedup(spark, sf):
    twice = stream(spark, sf).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.run_once(spark, streams.stream_dedup(twice).select("session_id", "uuid"), shared(spark, "dedup-rows"), "append", shared(spark, "dedup"))


@query("SELECT session_id, max(ts) AS last_ts, count(*) AS n FROM messages GROUP BY session_id")
def stream_activity(spark, sf):
    return streams.run_once(spark, streams.stream_activity(stream(spark, sf), "30 days"), shared(spark, "activity-rows"), "update", shared(spark, "activity"), ["session_id"])


@query("SELECT session_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n FROM messages) WHERE n <= 3 GROUP BY session_id")
def stream_tail(spark, sf):
    rows = streams.run_once(spark, streams.stream_tail(stream(spark, sf), 3, "30 days"), shared(spark, "tail-rows"), "update", shared(spark, "tail"), ["session_id"])
    return rows.select("session_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def store_of(spark: SparkSession, sf: str, messages: DataFrame) -> SessionStore:
    """A store of messages, sessions, segments and verdicts that holds the given messages."""
    shapes = {"messages": (messages.schema, "session_id"), "sessions": (D.sessions(spark, sf).schema, "id"), "segments": (D.segments(spark, sf).schema, "session_id"), "verdicts": (D.verdicts(spark, sf).schema, "session_id")}
    store = SessionStore.create(spark, shared(spark, "store"), shapes, 16)
    store.replace(messages, {"messages": messages})
    return store


@query("SELECT session_id, uuid, content FROM messages WHERE id % 3 <> 0 UNION ALL SELECT session_id, uuid, 'stored' FROM messages WHERE id % 3 = 0")
def stream_merge(spark, sf):
    """A store that holds a third of the messages, and the stream merged into it."""
    columns = ["id", "session_id", "uuid", "content"]
    store = store_of(spark, sf, D.messages(spark, sf).where("id % 3 = 0").withColumn("content", F.lit("stored")).select(*columns))
    streams.stream_merge(stream(spark, sf).select(*columns), store, shared(spark, "merge")).awaitTermination()
    return store.read("messages").select("session_id", "uuid", "content")


@query("SELECT session_id, id, content FROM messages")
def stream_ingest(spark, sf):
    """A store that holds half of the sessions, then each batch's sessions replaced in it."""
    store = store_of(spark, sf, D.messages(spark, sf).where("id % 2 = 0").withColumn("content", F.lit("old")).select("session_id", "id", "content"))
    streams.stream_ingest(stream(spark, sf).select("session_id", "id", "content"), store, shared(spark, "ingest")).awaitTermination()
    return store.read("messages")


def written_through(spark: SparkSession, sf: str) -> SessionStore:
    """The whole stream merged into a store, with its sessions, segments and verdicts."""
    columns = ["id", "session_id", "uuid", "content", "ts"]
    store = store_of(spark, sf, D.messages(spark, sf).where("id % 3 = 0").select(*columns))
    sides = {"sessions": D.sessions(spark, sf).withColumn("message_count", F.lit(0).cast("long")), "segments": D.segments(spark, sf), "verdicts": D.verdicts(spark, sf)}
    streams.stream_write_through(stream(spark, sf).select(*columns), sides, store, shared(spark, "through")).awaitTermination()
    return store


@query("""SELECT s.id, s.project, s.message_count, s.is_subagent, coalesce(g.n, 0) AS n_segments, v.verdict FROM sessions s
LEFT JOIN (SELECT session_id, count(*) AS n FROM segments GROUP BY 1) g ON g.session_id = s.id LEFT JOIN (SELECT DISTINCT session_id, verdict FROM verdicts) v ON v.session_id = s.id""")
def stream_write_through(spark, sf):
    store = written_through(spark, sf)
    n = store.read("segments").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_segments"))
    v = store.read("verdicts").select(F.col("session_id").alias("id"), "verdict")
    rows = store.read("sessions").join(n, "id", "left").join(v, "id", "left")
    return rows.select("id", "project", "message_count", "is_subagent", F.coalesce("n_segments", F.lit(0).cast("long")).alias("n_segments"), "verdict")


def topped_up(spark: SparkSession, sf: str) -> DataFrame:
    """The store after a vector top-up of the whole stream."""
    out = shared(spark, "topup")
    corpus = stream(spark, sf).select("session_id", X.content_hash(F.col("content")).alias("content_hash"), F.col("id").alias("msg_id"), F.col("content").alias("text")).where(F.length("text") >= V.LEAST_LENGTH)
    schema = "session_id string, content_hash string, msg_id long, vec array<float>"
    spark.createDataFrame([], schema).write.parquet(f"{out}/first")

    def write(rows: DataFrame, number: int) -> None:
        rows.write.parquet(f"{out}/{number}")

    streams.stream_vectors(corpus, hashed, lambda: spark.read.schema(schema).parquet(f"{out}/*"), write, shared(spark, "vectors")).awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/*")


@query("SELECT DISTINCT session_id, left(sha1(content), 16) AS content_hash FROM messages WHERE length(content) >= 12")
def stream_vectors_all(spark, sf):
    """Vector top-up: every text of the stream."""
    return topped_up(spark, sf).select("session_id", "content_hash")


@query("SELECT session_id, left(sha1(content), 16) AS content_hash, max(id) AS msg_id, CAST(len(content) - len(replace(lower(content), 'e', '')) AS DOUBLE) AS e_count FROM messages WHERE length(content) >= 12 GROUP BY session_id, content")
def stream_vectors(spark, sf):
    """Vector top-up of the whole stream: the stored table."""
    return topped_up(spark, sf).select("session_id", "content_hash", "msg_id", F.element_at("vec", 5).cast("double").alias("e_count"))
