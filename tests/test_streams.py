import time

import pytest
from pyspark.sql.types import StructType

from threadloom.sources.store import SessionStore
from threadloom.streaming import streams


def test_vectors_of_all_texts(spark, tmp_path):
    """Two batches of more than fifty texts each, with repeats and one text in the store."""
    source, store = f"file://{tmp_path}/in", f"file://{tmp_path}/store"
    texts = ["concat('s', id % 3) AS session_id", "concat('h', id DIV 2) AS content_hash", "id AS msg_id", "concat('text ', id DIV 2) AS text"]
    for first in (0, 180):  # the second file repeats twenty rows of the first
        spark.range(first, first + 200).selectExpr(*texts).coalesce(1).write.mode("append").parquet(source)
    schema = "session_id string, content_hash string, msg_id long, vec array<float>"
    spark.createDataFrame([("s0", "h0", 0, [9.0])], schema).write.parquet(f"{store}/first")
    corpus = spark.readStream.schema("session_id string, content_hash string, msg_id long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_vectors(corpus, lambda ts: [[float(len(t))] for t in ts], lambda: spark.read.schema(schema).parquet(f"{store}/*"), lambda rows, n: rows.write.parquet(f"{store}/{n}"), f"file://{tmp_path}/checkpoint").awaitTermination()
    got = [(r.session_id, r.content_hash) for r in spark.read.parquet(f"{store}/*").collect()]
    want = {(r.session_id, r.content_hash) for r in spark.read.parquet(source).select("session_id", "content_hash").collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_results_are_files_of_the_last_batch(spark, tmp_path):
    """Three batches; each session has its last row, and nothing passes through a memory sink."""
    source, schema = f"file://{tmp_path}/in", "session_id string, id long, uuid string, ts double"
    for first in (0, 8, 16):
        spark.range(first, first + 8).selectExpr("IF(id < 8, 'a', IF(id % 2 = 0, 'b', 'c')) AS session_id", "id", "concat('u', id % 12) AS uuid", "double(id) AS ts").coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    read = spark.read.parquet(source)

    def run(plan, mode, name, keys=()):
        got = streams.run_once(spark, plan, f"file://{tmp_path}/{name}", mode, f"file://{tmp_path}/{name}-state", keys)
        assert got.inputFiles() and got.columns == plan.columns
        return sorted(tuple(r) for r in got.collect())

    ids = {s: sorted(r.id for r in read.where(f"session_id = '{s}'").collect()) for s in "abc"}
    assert run(streams.stream_tail(rows, 3), "update", "tail", ["session_id"]) == [(s, ids[s][-3:]) for s in "abc"]
    assert run(streams.stream_activity(rows), "update", "activity", ["session_id"]) == [(s, float(ids[s][-1]), len(ids[s])) for s in "abc"]
    assert run(streams.stream_dedup(rows, None).select("session_id", "uuid"), "append", "dedup") == sorted({(r.session_id, r.uuid) for r in read.collect()})
    assert run(streams.stream_activity(rows.where("id < 0")), "update", "none", ["session_id"]) == []


def store(spark, path, rows):
    held = SessionStore.create(spark, path, {"messages": (rows.schema, "session_id"), "sessions": (StructType.fromDDL("id string, name string"), "id")}, 8)
    held.replace(rows, {"messages": rows})
    return held


def test_merge_publishes_changed_sessions_only(spark, tmp_path):
    """The second batch repeats the store's rows and changes nothing."""
    source, schema = f"file://{tmp_path}/in", "id long, session_id string, uuid string"
    for first in (0, 0, 6):
        spark.range(first, first + 6).selectExpr("id", "concat('s', id DIV 3) AS session_id", "concat('u', id) AS uuid").coalesce(1).write.mode("append").parquet(source)
    held = store(spark, f"file://{tmp_path}/store", spark.createDataFrame([(0, "s0", "u0"), (9, "s9", "u9")], schema))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_merge(rows, held, f"file://{tmp_path}/state").awaitTermination()
    assert held.state.version == 3  # the first content, and two batches of three
    assert sorted(r.uuid for r in held.read("messages").collect()) == sorted([f"u{i}" for i in range(12)] + ["u9"])


def test_a_commit_writes_its_buckets_alone_and_once(spark, tmp_path, monkeypatch):
    schema = "session_id string, id long"
    first = spark.range(200).selectExpr("concat('s', id % 50) AS session_id", "id")
    held = store(spark, f"file://{tmp_path}/store", first)
    before, reader = dict(held.state.folders["messages"]), held.read("messages")
    new = spark.createDataFrame([("s7", 1000)], schema)
    assert held.replace(new, {"messages": new, "sessions": spark.createDataFrame([("s7", "n")], "id string, name string")}, ("stream", 4))
    assert sum(before[b] != p for b, p in held.state.folders["messages"].items()) == 1
    want = {(r.session_id, r.id) for r in first.collect() if r.session_id != "s7"} | {("s7", 1000)}
    assert {(r.session_id, r.id) for r in held.read("messages").collect()} == want and held.read("sessions").count() == 1
    assert not held.replace(new, {}, ("stream", 4)) and {(r.session_id, r.id) for r in held.read("messages").collect()} == want
    assert reader.count() == 200  # what was opened stays
    monkeypatch.setattr("threadloom.sources.store._publish", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        held.replace(new, {}, ("stream", 5))
    held.reopen()
    assert {(r.session_id, r.id) for r in held.read("messages").collect()} == want


def test_idle_sessions_leave_the_state(spark, tmp_path):
    """A session that comes back after a month is counted anew; without a limit it is not."""
    source, schema = f"file://{tmp_path}/in", "session_id string, id long, ts double, event_time timestamp"
    for k, (session, day) in enumerate([("a", 1), ("b", 3), ("b", 20), ("b", 40), ("a", 41), ("b", 42)]):
        spark.sql(f"SELECT '{session}' AS session_id, {k}L AS id, double({day}) AS ts, timestamp_seconds({day} * 86400) AS event_time").coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def run(plan, name):
        got = streams.run_once(spark, plan, f"file://{tmp_path}/{name}", "update", f"file://{tmp_path}/{name}-state", ["session_id"])
        return {r.session_id: r.n for r in got.collect()}

    assert run(streams.stream_activity(rows), "all") == {"a": 2, "b": 4}
    assert run(streams.stream_activity(rows, "7 days"), "idle")["a"] == 1
