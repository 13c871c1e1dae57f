"""Token ids of a corpus as shuffled planes: fixed-size blocks, byte or bit planes, zstandard.

A stored corpus is a folder of Parquet files, so any store that Spark writes to can hold it
and task commits make it safe against lost executors. Each row is one chunk of up to BLOCK
ids of one part (parts and chunks are in corpus order): its planes, each compressed, and an
index of the documents that have ids in it. A chunk can be read without any other.

Ids of a block are transposed into planes: plane j holds byte j (or bit j) of every id, low
first; bit planes are packed eight ids to a byte. High planes are mostly zero and nearly
vanish.

Defined results: documents are in ascending doc_id order, null first; equal doc_ids follow in
any order; null texts are empty and still get their end id; extra columns are ignored; an
empty table gives an empty folder and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, lean, text_of
from .wordwise import WordEncoder, in_rows

#: Of what workers keep.
KIND = "byte_bpe"
#: The pre-tokenizer of byte-level files, as the library writes it.
USUAL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
BLOCK = 1 << 16
LEVEL = 3
END_ID = 0
#: Texts encoded at once.
ROWS = 1_000
#: Words of letters and, after them, marks: the encoder cuts them between the two, and nowhere else.
SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:-@[-`{-~]*")
_MARKS = re.compile("[!-&(-/:-@[-`{-~]+")
#: Between the pieces that are given to the encoder already cut.
SEP = "\x01"
#: Bytes of text in a part, about.
PART_BYTES = 32 << 20

CHUNK = "part int, chunk long, n_ids long, unit string, planes array<binary>, docs array<struct<doc_id: long, ordinal: long, n_ids: long, last: boolean>>"


def to_planes(ids: np.ndarray, unit: str = "byte", level: int = LEVEL) -> list[bytes]:
    """Compressed planes of one block of uint32 ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        planes = [np.ascontiguousarray(raw[:, j]) for j in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, j], bitorder="little") for j in range(32)]
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, unit: str = "byte") -> np.ndarray:
    """The n ids of one block."""
    press = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(press.decompress(bytes(p), max_output_size=max(n, 1)), np.uint8) for p in planes]
    if unit == "byte":
        return np.stack(raw, 1).reshape(-1).view("<u4") if n else np.zeros(0, np.uint32)
    bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in raw], 1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def _byte_letters() -> np.ndarray:
    """The code point that byte-level encoders spell each byte with; SEP and line ends are left."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, "<u4")
    out[shown] = shown
    rest = [b for b in range(256) if b not in set(shown)]
    out[rest] = 256 + np.arange(len(rest))
    for b in (SEP, "\n"):
        out[ord(b)] = ord(b)
    return out


def byte_bpe_encoder(path: str, threads: int = 2) -> WordEncoder:
    """Encoder of a byte-level BPE file of the tokenizers library, one for each worker."""

    def make() -> WordEncoder:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Tokenizer, pre_tokenizers

        own = Tokenizer.from_file(path)
        cut = Tokenizer(own.model)  # the same model, for text that is cut and spelled in its letters for bytes
        cut.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(SEP)
        letters = _byte_letters()
        special = [t.content for t in own.get_added_tokens_decoder().values()]

        def texts(many: list[str]) -> list[list[int]]:
            return [e.ids for e in own.encode_batch_fast(many, add_special_tokens=False)]

        # SIMPLE holds for the usual pattern of byte-level files alone.
        usual = own.normalizer is None and json.loads(own.to_str())["pre_tokenizer"] == USUAL and not any(SIMPLE.fullmatch(s) for s in special)
        begins = np.zeros(own.get_vocab_size(), bool)  # ids of tokens that start with a space
        begins[[i for t, i in own.get_vocab().items() if t[:1] == "\u0120"]] = True

        def quick(rows: list[str]) -> list[list[int]]:
            """Rows of simple words: what the pre-tokenizer's pattern and its spelling of bytes would
            give, made for all rows at once."""
            raw = _MARKS.sub(rf"{SEP}\g<0>", "\n".join(rows)).replace(" ", f"{SEP} ").encode()
            spelled = letters[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")
            return [e.ids for e in cut.encode_batch_fast(spelled.split("\n"), add_special_tokens=False)]

        def words(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
            return in_rows(many, texts, begins, *((SIMPLE, quick) if usual else ()))

        return WordEncoder(words, texts, True, "|".join(map(re.escape, special)) or "(?!)")

    return kept((KIND, path, os.getpid()), make)


def write_corpus(docs: DataFrame, path: str, tokenizer: str, unit: str = "byte", block: int = BLOCK, end_id: int = END_ID) -> None:
    """Encodes docs (doc_id, text), each with end_id after it, and writes the chunks to path."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_BYTES))
    # The hash and the random number only split rows of one doc_id over parts.
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text"), F.rand(7)).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, ordinal = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        room, index = block, []

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            row = {"part": part, "chunk": chunk, "n_ids": len(ids), "unit": unit, "planes": to_planes(ids, unit), "docs": index}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            coder = byte_bpe_encoder(tokenizer)
            ids, sizes = coder.encode(batch.column(1).to_pylist())
            pa.default_memory_pool().release_unused()
            at = 0
            for doc_id, n in zip(batch.column(0).to_pylist(), sizes.tolist()):
                left = np.append(ids[at : at + n], np.uint32(end_id))
                at += n
                while len(left):
                    piece, left = left[:room], left[room:]
                    held.append(piece)
                    room -= len(piece)
                    index.append({"doc_id": doc_id, "ordinal": ordinal, "n_ids": len(piece), "last": not len(left)})
                    if not room:
                        yield closed()
                        chunk, held, room, index = chunk + 1, [], block, []
                ordinal += 1
        if held:
            yield closed()

    doc = pa.struct([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("n_ids", pa.int64()), ("last", pa.bool_())])
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n_ids", pa.int64()), ("unit", pa.string()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(doc))])
    ordered.mapInArrow(lean(run, KIND), CHUNK).write.option("compression", "none").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """part, chunk, n_ids and start, the ids of the corpus before the chunk."""
    sizes = spark.read.schema(CHUNK).parquet(path).select("part", "chunk", "n_ids")
    starts = part_starts(spark, path).withColumnRenamed("part", "_part")
    from pyspark.sql import Window

    own = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    joined = sizes.join(starts, F.col("part") == F.col("_part"))
    return joined.select("part", "chunk", "n_ids", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))).alias("start"))


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part and part_start, the ids of all parts before it. One row for some PART_BYTES of text."""
    from pyspark.sql import Window

    totals = spark.read.schema(CHUNK).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every stretch of one document in one chunk, decoded: part, chunk, ordinal, doc_id, n_ids,
    before (ids of the chunk before it), last, crc and, if asked for, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                part, chunk, n, unit, planes = (one.column(c)[0].as_py() for c in ("part", "chunk", "n_ids", "unit", "planes"))
                doc_id, ordinal, sizes, last = one.column("docs").flatten().flatten()
                ids = from_planes(planes, n, unit)
                edges, raw = np.concatenate([[0], np.cumsum(sizes.to_numpy())]).astype(np.int64), memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                columns = {"part": pa.array(np.full(len(crcs), part, np.int32)), "chunk": pa.array(np.full(len(crcs), chunk, np.int64)), "ordinal": ordinal, "doc_id": doc_id, "n_ids": sizes, "before": pa.array(edges[:-1]), "last": last, "crc": pa.array(crcs, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "part int, chunk long, ordinal long, doc_id long, n_ids long, before long, last boolean, crc long" + ", ids array<long>" * with_ids
    return spark.read.schema(CHUNK).parquet(path).mapInArrow(lean(run), schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (with the end id) of every document, read back from the chunks."""
    rows = pieces(spark, path, True).groupBy("part", "ordinal", "doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("p"))
    return rows.select("doc_id", F.flatten(F.col("p.ids")).alias("ids"))


def _crc_shift() -> list[list[int]]:
    """Row j: what crc32 becomes, bit by bit, when 2**j zero bytes follow."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    table = []
    for j in range(3 + 60):
        if j >= 3:
            table.append(step)
        step = [_times(step, v) for v in step]
    return table


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for i in range(32):
        if v >> i & 1:
            out ^= matrix[i]
    return out


_shift: list[list[int]] = []


def crc_joined(crcs: list[int], sizes: list[int]) -> int:
    """crc32 of byte strings one after another, from the crc32 and the size of each."""
    if not _shift:
        _shift.extend(_crc_shift())
    out = 0
    for crc, n in zip(crcs, sizes):
        j = 0
        while n:
            if n & 1:
                out = _times(_shift[j], out)
            n >>= 1
            j += 1
        out ^= crc
    return out


@F.pandas_udf(T.LongType())
def _joined(parts: pd.Series) -> pd.Series:
    return pd.Series([crc_joined([p["crc"] for p in ps], [4 * p["n_ids"] for p in ps]) for ps in parts], dtype="int64")


def corpus_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    rows = pieces(spark, path)
    chunks = chunk_index(spark, path).select(F.col("part").alias("_part"), F.col("chunk").alias("_chunk"), "start")
    placed = rows.join(chunks, (F.col("part") == F.col("_part")) & (F.col("chunk") == F.col("_chunk"))).withColumn("start", F.col("start") + F.col("before"))
    # A document is one piece unless a chunk ends within it; only those few are put together.
    first = F.struct("chunk", "n_ids", "crc")
    joined = placed.groupBy("part", "ordinal", "doc_id").agg(F.min("start").alias("start"), F.sum("n_ids").alias("n_tokens"), F.count("*").alias("n"), F.min("crc").alias("crc"), F.array_sort(F.collect_list(first)).alias("p"))
    one = joined.where("n = 1").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    more = joined.where("n > 1").select("doc_id", "start", "n_tokens", _joined("p").alias("ids_crc32"))
    return one.union(more)


def crc_of(ids: Column) -> Column:
    """crc32 of an array of ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf(T.LongType())
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.asarray(r, "<u4").tobytes()) for r in rows], dtype="int64")

    return run(ids)
