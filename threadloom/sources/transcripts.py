"""Readers of raw transcripts: block, rollout and step JSON lines, aliased tables, file lists.

Each reader takes whole files (a transcript fits a task) so that lines keep their numbers, and
gives rows of session_id, line, role, content, ts, ts_iso, uuid. Lines that are blank, are no
JSON, or have no text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# Caps in code points, and the record types that are indexed.
BLOCK_CAP, TOOL_INPUT_CAP, TOOL_RESULT_CAP = 8000, 500, 1000
INDEXED = ("user", "assistant", "summary", "system")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime, size, line (from 0), raw of every non-blank line under a folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    meta = files.select("value", F.col("_metadata.file_path").alias("path"), F.unix_micros("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"))
    rows = meta.select("path", (F.col("mtime") / 1e6).alias("mtime"), "size", F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    return rows.where(F.trim("raw") != "")


def text_lines(rows: DataFrame, path: Column, line: Column, raw: Column) -> DataFrame:
    """The same shape from a table of lines."""
    return rows.select(path.alias("path"), F.lit(0.0).alias("mtime"), F.lit(0).cast("long").alias("size"), line.cast("int").alias("line"), raw.alias("raw")).where(F.trim("raw") != "")


def containers_from_paths(paths: DataFrame) -> DataFrame:
    """path, session_id, is_subagent, parent_id: a file under parent/subagents/ is parent/stem."""
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    parent = F.regexp_extract("path", r"([^/]+)/subagents/[^/]+\.jsonl$", 1)
    sub = parent != ""
    return paths.select("path", F.when(sub, F.concat(parent, F.lit("/"), stem)).otherwise(stem).alias("session_id"), sub.alias("is_subagent"), F.when(sub, parent).alias("parent_id"))


def json_dump(values: Column | str) -> Column:
    """JSON with sorted keys and a space after each comma and colon outside strings; other text
    as it is."""
    value = F.col(values) if isinstance(values, str) else values
    parsed = F.try_parse_json(value)
    return F.when(parsed.isNull(), value).otherwise(spaced(F.to_json(parsed)))


def spaced(compact: Column) -> Column:
    """Compact JSON with a space after each comma and colon outside strings."""
    parts = F.regexp_extract_all(compact, F.lit(r'("(?:[^"\\]|\\.)*"|[^"]+)'), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit('"')), p).otherwise(F.regexp_replace(p, "([,:])", "$1 "))), "")


def _get(path: str, kind: str = "string", record: str = "rec") -> Column:
    return F.try_variant_get(record, path, kind)


def block_text() -> Column:
    """Text of a block record (column rec): a plain text, or the parts of its blocks joined by a
    space: texts, thinking, tool calls with their input as spaced JSON, and of tool results the
    text or each text of a list."""
    content = F.try_variant_get("rec", "$.message.content", "variant")
    kind = lambda v: F.schema_of_variant(v)
    text = lambda v, path: F.when(kind(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    none = F.array().cast("array<string>")
    result = lambda t: F.concat(F.lit("[TOOL_RESULT] "), F.left(t, F.lit(TOOL_RESULT_CAP)))

    def parts(b: Column) -> Column:
        tool_input = F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("{}"))
        listed = F.coalesce(F.try_variant_get(b, "$.content", "array<variant>"), F.array().cast("array<variant>"))
        block = F.try_variant_get(b, "$.type", "string")
        return (
            F.when(block == "text", F.array(F.left(text(b, "$.text"), F.lit(BLOCK_CAP))))
            .when(block == "thinking", F.array(F.concat(F.lit("[THINKING] "), F.left(text(b, "$.thinking"), F.lit(BLOCK_CAP)))))
            .when(block == "tool_use", F.array(F.concat(F.lit("[TOOL:"), F.coalesce(text(b, "$.name"), F.lit("?")), F.lit("] "), F.left(spaced(tool_input), F.lit(TOOL_INPUT_CAP)))))
            .when((block == "tool_result") & text(b, "$.content").isNotNull(), F.array(result(text(b, "$.content"))))
            .when(block == "tool_result", F.transform(listed, lambda x: result(text(x, "$.text"))))
            .otherwise(none)
        )

    blocks = F.coalesce(F.try_variant_get("rec", "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    shown = F.filter(F.flatten(F.transform(blocks, parts)), lambda t: t.isNotNull() & (t != ""))
    return (
        F.when(_get("$.type") == "summary", F.concat(F.lit("[SUMMARY] "), F.coalesce(_get("$.summary"), F.lit(""))))
        .when((_get("$.type") == "system") & content.isNull(), F.concat(F.lit("[SYSTEM] "), F.coalesce(_get("$.content"), F.lit(""))))
        .when(kind(content).startswith("ARRAY"), F.array_join(shown, " ")).otherwise(F.left(text("rec", "$.message.content"), F.lit(BLOCK_CAP)))
    )


# Fields that carry a title, in order of preference, and its cap in code points.
TITLE_FIELDS, TITLE_CAP = ("ai_title", "summary", "custom_title", "title"), 80


def native_titles(rows: DataFrame) -> DataFrame:
    """session_id, title: the first title field of the first record (lines as from lines()) that
    carries one, as one line."""
    r = rows.withColumn("rec", F.try_parse_json("raw"))
    each = F.filter(F.array(*[F.left(X.collapse(F.coalesce(_get(f"$.{k}"), F.lit(""))), F.lit(TITLE_CAP)) for k in TITLE_FIELDS]), lambda t: t != "")
    titled = r.withColumn("title", F.get(each, F.lit(0))).where(F.col("title").isNotNull())
    named = titled.join(containers_from_paths(rows.select("path").distinct()).select("path", "session_id"), "path")
    return named.groupBy("session_id").agg(F.min_by("title", "line").alias("title"))


def read_block_jsonl(rows: DataFrame) -> DataFrame:
    """Messages of block records (lines as from lines())."""
    r = rows.withColumn("rec", F.try_parse_json("raw")).where(_get("$.type").isin(*INDEXED))
    r = r.join(containers_from_paths(rows.select("path").distinct()).select("path", "session_id"), "path")
    iso = F.coalesce(_get("$.timestamp"), F.lit(""))
    out = r.select("session_id", "line", X.non_empty(_get("$.message.role"), _get("$.type")).alias("role"), block_text().alias("content"), X.iso_to_epoch(iso).alias("ts"), iso.alias("ts_iso"), X.non_empty(_get("$.uuid"), _get("$.leafUuid")).alias("uuid"))
    return out.where(F.trim("content") != "")


def first_cwd(rows: DataFrame) -> DataFrame:
    """path, cwd: the first non-empty working directory of each file."""
    r = rows.withColumn("rec", F.try_parse_json("raw")).withColumn("cwd", X.non_empty(_get("$.cwd"), _get("$.payload.cwd")))
    return r.groupBy("path").agg(F.min_by("cwd", F.when(F.col("cwd") != "", F.col("line"))).alias("cwd"))


def rollout_containers(rows: DataFrame, look: int = 8) -> DataFrame:
    """path, session_id, cwd, parent_id, is_subagent from the header record in a file's first lines."""
    r = rows.where(F.col("line") < look).withColumn("rec", F.try_parse_json("raw")).where(_get("$.type") == "session_meta")
    parent = F.nullif(X.non_empty(_get("$.payload.parent_thread_id"), _get("$.payload.forked_from_id")), F.lit(""))
    head = F.struct(_get("$.payload.id").alias("session_id"), _get("$.payload.cwd").alias("cwd"), parent.alias("parent_id"), (_get("$.payload.thread_source") == "subagent").alias("sub"))
    per = r.groupBy("path").agg(F.min_by(head, "line").alias("h"))
    return per.select("path", "h.session_id", "h.cwd", "h.parent_id", F.coalesce("h.sub", F.lit(False)).alias("is_subagent"))


def normalize_rollout(rows: DataFrame) -> DataFrame:
    """Messages of rollout items, with marks for what is no plain text."""
    r = rows.withColumn("rec", F.try_parse_json("raw")).where(_get("$.type") == "response_item")
    p = lambda k: F.coalesce(_get(f"$.payload.{k}"), F.lit(""))
    blocks = lambda k: F.array_join(F.filter(F.transform(F.coalesce(F.from_json(_get(f"$.payload.{k}"), "array<struct<text:string>>"), F.array()), lambda b: b["text"]), lambda t: t.isNotNull() & (t != "")), "\n")
    kind = _get("$.payload.type")
    text = (
        F.when(kind == "message", blocks("content"))
        .when(kind == "reasoning", F.concat(F.lit("[THINKING] "), blocks("summary")))
        .when(kind.isin("function_call", "custom_tool_call"), F.concat(F.lit("[TOOL:"), p("name"), F.lit("] "), F.left(X.non_empty(p("arguments"), p("input")), F.lit(TOOL_INPUT_CAP))))
        .when(kind.isin("function_call_output", "custom_tool_call_output"), F.concat(F.lit("[TOOL_RESULT] "), F.left(p("output"), F.lit(TOOL_RESULT_CAP))))
        .when(kind.isin("web_search_call", "tool_search_call", "local_shell_call"), F.concat(F.lit("[TOOL:"), kind, F.lit("] "), F.left(p("action"), F.lit(TOOL_INPUT_CAP))))
        .when(kind == "image_generation_call", F.concat(F.lit("[TOOL:image] "), p("prompt")))
    )
    role = F.when(kind == "message", X.normalize_role(p("role"))).when(kind.endswith("_output"), "user").otherwise("assistant")
    heads = rollout_containers(rows).select("path", "session_id")
    iso = F.coalesce(_get("$.timestamp"), F.lit(""))
    out = r.join(heads, "path").select("session_id", "line", role.alias("role"), text.alias("content"), X.iso_to_epoch(iso).alias("ts"), iso.alias("ts_iso"), X.mint_uuid(F.col("session_id"), F.col("line").cast("string")).alias("uuid"))
    return out.where(F.trim("content") != "")


def normalize_steplog(rows: DataFrame) -> DataFrame:
    """Messages of step records; the session is the file's name."""
    r = rows.withColumn("rec", F.try_parse_json("raw")).where(_get("$.step_index", "long").isNotNull())
    kind, content = _get("$.type"), F.coalesce(_get("$.content"), F.lit(""))
    asked = F.regexp_extract(content, r"(?s)<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>", 1)
    calls = F.coalesce(F.from_json(_get("$.tool_calls"), "array<struct<name:string,args:string>>"), F.array())
    said = F.concat_ws(" ", F.when(F.coalesce(_get("$.thinking"), F.lit("")) != "", F.concat(F.lit("[THINKING] "), _get("$.thinking"))), F.nullif(content, F.lit("")), F.nullif(F.array_join(F.transform(calls, lambda c: F.concat(F.lit("[TOOL:"), c["name"], F.lit("] "), F.left(F.coalesce(c["args"], F.lit("")), F.lit(TOOL_INPUT_CAP)))), " "), F.lit("")))
    text = F.when(kind == "USER_INPUT", F.when(asked != "", asked).otherwise(content)).when(kind == "PLANNER_RESPONSE", said).when(kind == "SYSTEM_MESSAGE", F.concat(F.lit("[SYSTEM] "), content)).otherwise(F.concat(F.lit("[TOOL_RESULT] "), F.left(content, F.lit(TOOL_RESULT_CAP))))
    role = F.when(kind == "USER_INPUT", "user").when(kind == "SYSTEM_MESSAGE", "system").otherwise("assistant")
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    iso = F.coalesce(_get("$.created_at"), F.lit(""))
    out = r.where(~F.coalesce(kind, F.lit("")).isin("HISTORY", "CHECKPOINT")).select(stem.alias("session_id"), "line", role.alias("role"), text.alias("content"), X.iso_to_epoch(iso).alias("ts"), iso.alias("ts_iso"), X.mint_uuid(stem, _get("$.step_index"), F.col("line").cast("string")).alias("uuid"))
    return out.where((F.trim("content") != "") & (F.trim("content") != "[TOOL_RESULT]"))


def steplog_containers(rows: DataFrame, history: DataFrame, look: int = 50) -> DataFrame:
    """session_id, cwd, parent_id: the working directory from the history (conversationId,
    workspace), else from a file's first lines; the parent from records that name a spawned id."""
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    named = rows.select(stem.alias("session_id"), "line", F.regexp_extract("raw", r'"(?:cwd|Cwd|workspace)"\s*:\s*"([^"]+)"', 1).alias("own")).where(F.col("line") < look)
    own = named.groupBy("session_id").agg(F.min_by("own", F.when(F.col("own") != "", F.col("line"))).alias("own"))
    spawned = rows.select(stem.alias("parent_id"), F.explode(F.regexp_extract_all("raw", F.lit(r'"spawned_id"\s*:\s*"([^"]+)"'), F.lit(1))).alias("session_id")).groupBy("session_id").agg(F.min("parent_id").alias("parent_id"))
    h = history.select(F.col("conversationId").alias("session_id"), F.col("workspace"))
    return own.join(h, "session_id", "left").join(spawned, "session_id", "left").select("session_id", F.coalesce(F.nullif("workspace", F.lit("")), "own").alias("cwd"), "parent_id")


# Names that columns of databases go by, in order of preference.
ALIASES = {
    "session_id": ("session_id", "session", "sess_id", "thread_id", "conversation_id", "sessionId"), "id": ("id", "message_id", "mid", "rowid", "seq"), "role": ("role", "sender", "author", "type"),
    "content": ("content_json", "content", "text", "body", "message", "payload"), "ts": ("created_timestamp", "created_at", "timestamp", "created", "ts", "time", "date"),
}
SESSION_ALIASES = {
    "session_id": ("id", "session_id", "name"), "cwd": ("working_dir", "cwd", "workdir", "directory", "project_path"), "parent_id": ("parent_id", "parent_session_id", "parent"), "is_subagent": ("is_subagent", "subagent", "is_sub"),
}


def _named(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> dict[str, str | None]:
    have = {c.lower(): c for c in rows.columns}
    return {k: next((have[a.lower()] for a in names if a.lower() in have), None) for k, names in aliases.items()}


def aliased_sessions(rows: DataFrame) -> DataFrame:
    """session_id, cwd, parent_id, is_subagent of a database's table of sessions; rows without
    an id are left out."""
    found = _named(rows, SESSION_ALIASES)
    if found["session_id"] is None:
        raise ValueError("an id column is needed")
    col = lambda k: F.coalesce(F.col(found[k]).cast("string"), F.lit("")) if found[k] else F.lit("")
    out = rows.select(col("session_id").alias("session_id"), col("cwd").alias("cwd"), F.nullif(col("parent_id"), F.lit("")).alias("parent_id"), F.lower(col("is_subagent")).isin("1", "true", "yes").alias("is_subagent"))
    return out.where("session_id <> ''")


def normalize_aliased_table(rows: DataFrame) -> DataFrame:
    """Messages of a database's table, whatever its columns are called."""
    found = _named(rows, ALIASES)
    if found["session_id"] is None or found["content"] is None:
        raise ValueError("a session and a content column are needed")
    col = lambda k, other: F.col(found[k]).cast("string") if found[k] else F.lit(other)
    ts = X.normalize_epoch(col("ts", ""))
    out = rows.select(col("session_id", "").alias("session_id"), col("id", "0").cast("long").alias("line"), X.normalize_role(col("role", "")).alias("role"), col("content", "").alias("content"), ts.alias("ts"))
    return out.where(F.trim("content") != "").withColumn("uuid", X.mint_uuid(F.col("session_id"), F.col("line").cast("string")))


def to_block_jsonl(messages: DataFrame) -> DataFrame:
    """session_id, id, value: messages as block records; unknown roles are carried as system."""
    kind = F.when(F.col("role").isin("user", "assistant", "system"), F.col("role")).otherwise("system")
    record = F.struct(kind.alias("type"), "uuid", F.col("ts_iso").alias("timestamp"), F.struct(F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("content")).alias("message"))
    return messages.select("session_id", "id", F.to_json(record).alias("value"))


def write_block_jsonl(messages: DataFrame, path: str) -> None:
    """One folder of lines a session, in id order."""
    rows = to_block_jsonl(messages)
    rows.repartition("session_id").sortWithinPartitions("session_id", "id").select("session_id", "value").write.partitionBy("session_id").text(path)


def rebuild_from_vault(rows: DataFrame, meta: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row: sessions, messages, missing (no file), tombstoned, unreadable (no message) of a
    vault of raw files (lines) and metadata (session_id, path)."""
    dead = meta.join(tombstones, "session_id", "left_semi")
    alive = meta.join(tombstones, "session_id", "left_anti")
    files = rows.select("path").distinct().withColumn("here", F.lit(True))
    counts = read_block_jsonl(rows).groupBy("session_id").agg(F.count("*").alias("n"))
    joined = alive.join(files, "path", "left").join(counts, "session_id", "left")
    totals = joined.agg(F.count_if(F.col("n") > 0).alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.count_if(F.col("here").isNull()).alias("missing"), F.count_if(F.col("here").isNotNull() & F.col("n").isNull()).alias("unreadable"))
    return totals.join(F.broadcast(dead.agg(F.count("*").alias("tombstoned"))))
