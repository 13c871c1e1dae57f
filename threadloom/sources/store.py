"""A store of sessions and what belongs to them, in hash buckets of the session.

Each relation (messages, sessions, segments, verdicts …) lies in folders by bucket. A commit
replaces all rows of some sessions in every relation at once: only the buckets of these sessions
are written, to new folders, and then a manifest that names the folder of every bucket. So a
commit that fails leaves the old state, readers keep what they have opened, and a commit of a
stream's batch that was published already does nothing. There is one writer at a time: the
second one to publish a version fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import children, held

BUCKETS = 64


@dataclass
class State:
    buckets: int
    #: Of each relation its schema and the column that holds the session.
    schemas: dict[str, str]
    keys: dict[str, str]
    #: Of each relation, the folder of each bucket that has rows.
    folders: dict[str, dict[str, str]] = field(default_factory=dict)
    #: Of each stream, the last batch that was published.
    batches: dict[str, int] = field(default_factory=dict)
    version: int = 0


class SessionStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.reopen()

    @classmethod
    def create(cls, spark: SparkSession, path: str, relations: dict[str, tuple[StructType, str]], buckets: int = BUCKETS) -> SessionStore:
        """relations: schema and session column by name. buckets bound what a commit of one session
        reads and writes; the driver holds a name for each bucket and relation."""
        state = State(buckets, {n: s.json() for n, (s, _) in relations.items()}, {n: k for n, (_, k) in relations.items()}, {n: {} for n in relations})
        _publish(spark, path, state)
        return cls(spark, path)

    def reopen(self) -> None:
        """Turns to the newest published state."""
        version = max(int(p.rsplit("/", 2)[-2]) for p in children(self.spark, f"{self.path}/manifest/*/_SUCCESS"))
        self.state = State(**json.loads(self.spark.read.text(f"{self.path}/manifest/{version:09d}").first()[0]))

    def read(self, relation: str, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a relation, or of some of its buckets."""
        schema = StructType.fromJson(json.loads(self.state.schemas[relation]))
        paths = [p for b, p in self.state.folders[relation].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*sorted(paths)) if paths else held(self.spark, [], schema)

    def touched(self, sessions: DataFrame) -> set[int]:
        """The buckets of sessions (session_id)."""
        return {r[0] for r in sessions.select(self._bucket("session_id").alias("b")).distinct().collect()}  # at most buckets rows

    def replace(self, sessions: DataFrame, rows: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> bool:
        """Puts rows (by relation) in the place of all that the store has of sessions (session_id),
        in every relation; those that rows does not name lose theirs. batch names a stream and
        its batch; False if that was published before."""
        if batch and self.state.batches.get(batch[0], -1) >= batch[1]:
            return False
        sessions = sessions.select("session_id").distinct()
        some = self.touched(sessions)
        folders = {n: dict(f) for n, f in self.state.folders.items()}
        for name, key in self.state.keys.items():
            kept = self.read(name, some)
            gone = sessions.withColumnRenamed("session_id", "_gone")
            whole = kept.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
            if name in rows:
                whole = whole.unionByName(rows[name].select(*whole.columns))
            at = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
            whole.withColumn("_bucket", self._bucket(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(at)
            new = {p.rsplit("=", 1)[1]: p for p in children(self.spark, f"{at}/_bucket=*")}
            folders[name] = {b: p for b, p in folders[name].items() if int(b) not in some} | new
        batches = self.state.batches | ({batch[0]: batch[1]} if batch else {})
        _publish(self.spark, self.path, State(self.state.buckets, self.state.schemas, self.state.keys, folders, batches, self.state.version + 1))
        self.reopen()
        return True

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.state.buckets)).cast("int")


def _publish(spark: SparkSession, path: str, state: State) -> None:
    spark.createDataFrame([(json.dumps(state.__dict__),)], "value string").coalesce(1).write.text(f"{path}/manifest/{state.version:09d}")
