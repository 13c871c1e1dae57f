"""What the training-data operators share: the shared folder, materialised tables, word rules."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: A word, as a Java and a Python pattern.
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a session in one process (tests) gets a temporary folder; a cluster
    has no folder that is known to be shared, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-threadloom-")
    return _local[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage safely:
    the files outlive executors, unlike local checkpoints."""
    return _saved(df, scratch(df.sparkSession, name))


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Materialised tables of one computation; on leaving, they are removed from the shared folder.
    What the computation returns is materialised outside it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(scratch(self.spark, name))
        return _saved(df, self.paths[-1])

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: What this Python worker keeps for its later tasks: by kind and what else tells it apart.
_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What make() gives, made once in a worker and kept until a task of another kind (key[0]) begins."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def lean(run: Callable[[Iterator], Iterator], kind: str | None = None) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, mapInPandas or an iterator UDF, in workers that outlive their stage: what
    tasks of other kinds kept goes before it, and freed memory goes back to the system around it."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        drop_others(kind)
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def drop_others(kind: str | None) -> None:
    """Of the module, as a closure would get a copy of _kept."""
    other = [key for key in _kept if key[0] != kind]
    for key in other:
        del _kept[key]
    if other:
        gc.collect()


def give_back() -> None:
    """Freed memory that Arrow and the C library still hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """16 bytes that tell texts apart: equal texts, and only they, share it."""
    return F.unhex(F.md5(text_of(column)))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name made from stem that df does not have (Spark compares names without case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name
