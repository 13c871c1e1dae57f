"""A registry of sources: a name, a test of paths, and a reader of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import transcripts

Test, Reader = Callable[[Column], Column], Callable[[DataFrame], DataFrame]
_sources: dict[str, tuple[Test, Reader]] = {}


def register_source(name: str, detects: Test, reader: Reader) -> None:
    """Adds a source, or replaces the one of that name."""
    _sources[name] = (detects, reader)


def detect_source(path: Column) -> Column:
    """The first source, in order of registration, that takes a path for its own; null if none does."""
    told = F.lit(None).cast("string")
    for name, (detects, _) in reversed(_sources.items()):
        told = F.when(detects(path), name).otherwise(told)
    return told


def read_source(name: str, lines: DataFrame) -> DataFrame:
    return _sources[name][1](lines)


def read_mixed(lines: DataFrame) -> DataFrame:
    """The messages of lines (as from transcripts.lines) of files of any kind, each file read by
    its own source, which is told. Lines of files that no source takes are left out."""
    told, rows = lines.withColumn("_source", detect_source(F.col("path"))), None
    for name in _sources:
        own = read_source(name, told.where(F.col("_source") == name).drop("_source")).withColumn("source", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return rows


register_source("rollout", lambda p: p.contains("rollout-"), transcripts.normalize_rollout)
register_source("steps", lambda p: p.contains("/steps/"), transcripts.normalize_steplog)
register_source("blocks", lambda p: p.endswith(".jsonl"), transcripts.read_block_jsonl)
