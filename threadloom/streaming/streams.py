"""Incremental forms of ingestion, de-duplication, activity, tails and vector top-up."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import merging, vectors
from ..sources.store import SessionStore


def _into(batches: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(batches: DataFrame, store: SessionStore, checkpoint: str) -> StreamingQuery:
    """Each batch of new messages replaces its sessions in the store, of which it writes the
    buckets of these sessions alone; a batch that was published before changes nothing."""
    return _into(batches, lambda batch, number: store.replace(batch, {"messages": batch}, (checkpoint, number)), checkpoint)


def _changed(store: SessionStore, batch: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The sessions that a batch brings new messages of, and their messages, stored and new; None
    if there are none."""
    own = store.read("messages", store.touched(batch))
    fresh = batch.join(own.select("session_id", "uuid"), ["session_id", "uuid"], "left_anti").select("session_id").distinct()
    if fresh.isEmpty():
        return None
    both = own.withColumn("store", F.lit(0)).unionByName(batch.select(*own.columns).withColumn("store", F.lit(1)))
    return fresh, merging.merge_messages(both.join(fresh, "session_id", "left_semi")).drop("store", "new_id")


def stream_merge(batches: DataFrame, store: SessionStore, checkpoint: str) -> StreamingQuery:
    """Each batch of messages is merged into the store: the sessions that it changes are
    published whole and without copies. Batches that bring nothing new publish nothing."""

    def each(batch: DataFrame, number: int) -> None:
        found = _changed(store, batch)
        if found:
            store.replace(found[0], {"messages": found[1]}, (checkpoint, number))

    return _into(batches, each, checkpoint)


def stream_write_through(batches: DataFrame, sides: dict[str, DataFrame], store: SessionStore, checkpoint: str) -> StreamingQuery:
    """As stream_merge, for all that belongs to a session: the rows of its batch's sessions in
    sides (sessions by id, segments and verdicts by session_id) are merged with the stored ones
    by the rules for stores, message counts are those of the merged messages, and all relations
    are published at once."""

    def each(batch: DataFrame, number: int) -> None:
        found = _changed(store, batch)
        if not found:
            return
        changed, messages = found
        some = store.touched(changed)

        def both(name: str, key: str) -> DataFrame:
            old = store.read(name, some)
            rows = old.withColumn("store", F.lit(0)).unionByName(sides[name].select(*old.columns).withColumn("store", F.lit(1)))
            return rows.join(changed.select(F.col("session_id").alias("_changed")), F.col(key) == F.col("_changed"), "left_semi")

        rows = {
            "messages": messages, "sessions": merging.merge_sessions(both("sessions", "id"), messages),
            "segments": merging.merge_topics(both("segments", "session_id")).drop("store"), "verdicts": merging.merge_verdicts(both("verdicts", "session_id")).drop("store"),
        }
        store.replace(changed, rows, (checkpoint, number))

    return _into(batches, each, checkpoint)


def stream_dedup(messages: DataFrame, delay: str | None = "7 days", time: str = "event_time") -> DataFrame:
    """messages without repeats of (session_id, uuid) within the delay, for which state is kept;
    with None, without any repeat, at the price of state that grows with the stream."""
    if delay is None:
        return messages.dropDuplicates(["session_id", "uuid"])
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["session_id", "uuid"])


def _per_session(messages: DataFrame, step: Callable[[tuple | None, pd.DataFrame], tuple], names: list[str], out: str, state: str, idle: str | None, time: str) -> DataFrame:
    """One row a session and batch from what is held of it; with idle, sessions without a message
    for that long (in event time) leave the state."""
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else None
        for frame in frames:
            now = step(now, frame)
        held.update(now)
        if wait is not None:  # from the watermark on, as that never passes a message's own time by more than the delay
            held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs(), 0) + wait)
        yield pd.DataFrame({"session_id": [key[0]], **{n: [v] for n, v in zip(names, now)}})

    rows = messages if idle is None else messages.withWatermark(time, idle)
    rows = rows.select("session_id", "id", "ts", *([] if idle is None else [time]))
    return rows.groupBy("session_id").applyInPandasWithState(update, out, state, "update", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout)


def stream_activity(messages: DataFrame, idle: str | None = None, time: str = "event_time") -> DataFrame:
    """session_id, last_ts, n, after each batch (update mode). With idle, sessions that have been
    idle for so long are forgotten, and counted anew should they come back."""

    def step(now: tuple | None, frame: pd.DataFrame) -> tuple:
        last, n = now or (float("-inf"), 0)
        return max(last, float(frame["ts"].max())), n + len(frame)

    return _per_session(messages, step, ["last_ts", "n"], "session_id string, last_ts double, n long", "last_ts double, n long", idle, time)


def stream_tail(messages: DataFrame, n: int = 5, idle: str | None = None, time: str = "event_time") -> DataFrame:
    """session_id, ids: the n largest ids of each session so far, after each batch (update mode).
    With idle, sessions that have been idle for so long are forgotten."""

    def step(now: tuple | None, frame: pd.DataFrame) -> tuple:
        return (sorted({*(now[0] if now else []), *frame["id"].tolist()})[-n:],)

    return _per_session(messages, step, ["ids"], "session_id string, ids array<long>", "ids array<long>", idle, time)


def stream_vectors(corpus: DataFrame, embed: Callable, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch of corpus rows gets vectors for all that the store lacks, as no later batch
    brings a row again; of equal texts in a session the later row counts."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("session_id", "content_hash").agg(F.max("msg_id").alias("msg_id"), F.max_by("text", "msg_id").alias("text"))
        todo = vectors.vector_delta(rows.drop("text"), read()).where("action = 'embed'")
        write(vectors.embed_corpus(rows.join(todo.select("session_id", "content_hash"), ["session_id", "content_hash"], "left_semi"), embed), number)

    return corpus.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(spark: SparkSession, rows: DataFrame, path: str, mode: str, checkpoint: str, keys: Sequence[str] = ()) -> DataFrame:
    """Runs a streaming plan over what is there now and gives its result. Each batch is written
    to path, which executors share; in update and complete mode the last batch's row of each
    key counts."""
    if mode != "append" and not keys:
        raise ValueError(f"mode {mode} needs keys")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{path}/batch_no=-1")  # a result without any batch
    rows.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(StructType([*rows.schema]).add("batch_no", "long")).parquet(path)
    if mode == "append":
        return found.drop("batch_no")
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch_no").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col("last")[c].alias(c) for c in rows.columns])
