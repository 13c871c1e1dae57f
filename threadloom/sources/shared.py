"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_local: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, a session in one process (tests)
    has a temporary folder of its own; on a cluster no folder is known to be shared, so that is
    an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="spark-threadloom-")
        _local[app] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def children(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern names, in any store that Spark reads; [] if there are none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return [str(f.getPath()) for f in found or []]


def written(frame: DataFrame, name: str) -> DataFrame:
    """frame, computed once: written to the shared folder and read from there."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def held(spark: SparkSession, rows: Iterable[Sequence], schema: StructType | str) -> DataFrame:
    """A table of few rows that the plan itself holds, so that reading it starts no job."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    fields = to_arrow_schema(schema)
    found = [dict(zip(schema.names, (x.asDict(True) if isinstance(x, Row) else x for x in r))) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(found, schema=fields), schema)
