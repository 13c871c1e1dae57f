"""A stored word index: postings and document frequencies by term, in segments.

Postings lie in folders by a hash of the term, sorted by term, so a search for a few terms reads
the row groups of these alone. A text's words are counted within its task, from Arrow batches,
and one shuffle deals the finished postings; the number of folders and files follows from the
size of the corpus, and a word that very many texts have is spread over all files of its folder.
The folder -1 has one row a text with its length, from which the totals follow.

An index is a list of immutable segments that a manifest names. update_index writes the changed
texts as a new segment, and the ids that it replaces or removes as its delete vector, which holds
for all older segments; frequencies are additive, so those of removed texts are subtracted. The
manifest is written last, so a failed update leaves the old state, and a reader that has opened
the index keeps what it opened. Many segments are folded into one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import children, held
from .stemming import stem as stem_word

#: Terms of a query table that are looked up by value; more are joined.
MOST_TERMS = 1_000
#: Characters of text a file of postings stands for, least and most, and folders at most.
LEAST_CHARS, MOST_CHARS, MOST_BUCKETS = 1 << 21, 1 << 28, 1024
#: Segments that are folded into one by the next update.
FOLD = 8
#: Texts whose words are counted at once.
ROWS = 512
#: The folder of text lengths.
TEXTS = -1


@dataclass(frozen=True)
class WordIndex:
    #: term, id, len (words of the text), tf, positions, bucket; one row a term and text.
    postings: DataFrame
    #: term, df, bucket.
    terms: DataFrame
    #: One row: n_docs, avg_len.
    totals: DataFrame
    buckets: int = 1
    #: None, or 'porter': postings are of stems, and so are to be the terms that are looked up.
    stem: str | None = None


@dataclass
class Manifest:
    buckets: int
    stem: str | None
    id_type: str
    #: Segments in order of age, and whether each has a delete vector.
    segments: list[str] = field(default_factory=list)
    deletes: list[bool] = field(default_factory=list)
    #: Live texts, and their mean length in words (of those that are not null).
    n_docs: int = 0
    avg_len: float | None = None


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _counted(docs: DataFrame, id_column: str, text: str, stem: str | None) -> DataFrame:
    """term, id, len, tf, positions; and for each text the empty term with its length (null for
    a null text) and nothing else."""
    texts = docs.select(F.col(id_column).alias("id"), X.tokens(F.col(text)).alias("tokens"))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                ids, lists = batch.column(0), batch.column(1)
                size = pc.list_value_length(lists)
                n = pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy()
                if stem and len(words):
                    told = [stems.get(w) or stems.setdefault(w, stem_word(w)) for w in words.to_pylist()]
                    if len(stems) > 200_000:
                        stems.clear()
                    merged = pa.array(told, pa.string()).dictionary_encode()
                    words, code = merged.dictionary, merged.indices.to_numpy()[code]
                doc = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                order = np.argsort(code, kind="stable")  # places are in order of text and place already
                code, doc, at = code[order], doc[order], at[order]
                first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.zeros(0, np.int64)
                ends = np.r_[first, len(code)]
                rows = doc[first]
                term = pa.concat_arrays([words.take(pa.array(code[first])).cast(pa.string()), pa.array([""] * len(n), pa.string())])
                tf = np.r_[np.diff(ends), n].astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(np.r_[ends, np.full(len(n), len(code))].astype(np.int32)), pa.array(at.astype(np.int32)))
                lens = pa.concat_arrays([pa.array(n[rows].astype(np.int32)), size.cast(pa.int32())])
                yield pa.RecordBatch.from_arrays([term, pa.concat_arrays([ids.take(pa.array(rows)), ids]), lens, pa.array(tf), places], ["term", "id", "len", "tf", "positions"])

    return texts.mapInArrow(run, f"term string, id {kind}, len int, tf int, positions array<int>")


def _with_totals(spark: SparkSession, path: str, m: Manifest) -> Manifest:
    m.n_docs, m.avg_len = _live(spark, path, m, True).agg(F.count("*"), F.avg("len")).first()
    return m


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("bucket", "term").agg(F.count("*").alias("df")).select("term", "df", "bucket")


def build_index(docs: DataFrame, id_column: str = "id", text: str = "content", stem: str | None = None) -> WordIndex:
    """The index of docs as a plan: nothing is written, and each use reads the texts again."""
    rows = _counted(docs, id_column, text, stem).withColumn("bucket", F.lit(0))
    postings = rows.where("term <> ''")
    return WordIndex(postings, _terms(postings), docs.agg(F.count("*").alias("n_docs"), F.avg(X.n_tokens(F.col(text))).alias("avg_len")), 1, stem)


def _dealt(docs: DataFrame, text: str) -> tuple[int, int, DataFrame]:
    """Folders, and files of each: enough files to occupy the cluster, none too small or large; and
    docs, spread over the cluster if they are so few that a scan of theirs may be a few tasks."""
    chars, cores = docs.agg(F.sum(F.length(text))).first()[0] or 0, docs.sparkSession.sparkContext.defaultParallelism
    each = min(MOST_CHARS, max(LEAST_CHARS, chars // (2 * cores)))
    files = max(1, -(-chars // each))
    buckets = min(MOST_BUCKETS, files)
    return buckets, -(-files // buckets), docs.repartition(min(files, 2 * cores)) if 1 < files and each < MOST_CHARS else docs


def _write_segment(rows: DataFrame, path: str, buckets: int, files: int) -> None:
    """rows: as of _counted. Writes postings, and from these the terms."""
    spark = rows.sparkSession
    spread = F.pmod(F.xxhash64("term", "id"), F.lit(files))
    home = F.when(F.col("term") == "", F.pmod(F.xxhash64("id"), F.lit(files * buckets))).otherwise(bucket_of("term", buckets) * files + spread).cast("int")
    dealt = rows.withColumn("bucket", F.when(F.col("term") == "", TEXTS).otherwise(bucket_of("term", buckets))).repartitionById(buckets * files, home)
    dealt.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    kind = rows.schema["id"].dataType.simpleString()
    stored = _read(spark, f"{path}/postings", kind).where(F.col("bucket") != TEXTS)
    _terms(stored).repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"term string, id {kind}, len int, tf int, positions array<int>, bucket int").parquet(path)


def _save_manifest(spark: SparkSession, path: str, m: Manifest, version: int) -> None:
    spark.createDataFrame([(json.dumps(m.__dict__),)], "value string").coalesce(1).write.text(f"{path}/manifest/{version:09d}")


def _manifest(spark: SparkSession, path: str) -> tuple[Manifest, int]:
    """The newest manifest that was written in full."""
    version = max(int(p.rsplit("/", 2)[-2]) for p in children(spark, f"{path}/manifest/*/_SUCCESS"))
    return Manifest(**json.loads(spark.read.text(f"{path}/manifest/{version:09d}").first()[0])), version


def write_index(docs: DataFrame, path: str, id_column: str = "id", text: str = "content", stem: str | None = None) -> WordIndex:
    """Writes the index of docs to path and opens it."""
    spark, (buckets, files, spread) = docs.sparkSession, _dealt(docs.select(id_column, text), text)
    rows, name = _counted(spread, id_column, text, stem), f"segments/{uuid.uuid4().hex}"
    _write_segment(rows, f"{path}/{name}", buckets, files)
    m = _with_totals(spark, path, Manifest(buckets, stem, rows.schema["id"].dataType.simpleString(), [name], [False]))
    _save_manifest(spark, path, m, 0)
    return _open(spark, path, m)


def open_index(spark: SparkSession, path: str) -> WordIndex:
    return _open(spark, path, _manifest(spark, path)[0])


def _live(spark: SparkSession, path: str, m: Manifest, texts: bool) -> DataFrame:
    """Rows of all segments that no later delete vector names: lengths of texts, or postings."""
    found = None
    for i, s in enumerate(m.segments):
        rows = _read(spark, f"{path}/{s}/postings", m.id_type).where(F.col("bucket") == TEXTS if texts else F.col("bucket") != TEXTS).withColumn("_age", F.lit(i))
        found = rows if found is None else found.unionByName(rows)
    for i, (s, d) in enumerate(zip(m.segments, m.deletes)):
        if d:  # the ids of one update, so the join is as small as the update
            gone = spark.read.schema(f"id {m.id_type}").parquet(f"{path}/{s}/gone").select(F.col("id").alias("_gone"))
            found = found.join(gone, (F.col("id") == F.col("_gone")) & (F.col("_age") < i), "left_anti")
    return found.drop("_age")


def _open(spark: SparkSession, path: str, m: Manifest) -> WordIndex:
    read = lambda s, kind: spark.read.schema("term string, df long, bucket int").parquet(f"{path}/{s}/{kind}")
    counts = read(m.segments[0], "terms")
    if len(m.segments) > 1:
        for part in [read(s, "terms") for s in m.segments[1:]] + [read(s, "less") for s, d in zip(m.segments, m.deletes) if d]:
            counts = counts.unionByName(part)
        counts = counts.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0").select("term", "df", "bucket")
    totals = held(spark, [(m.n_docs, m.avg_len)], "n_docs long, avg_len double")
    return WordIndex(_live(spark, path, m, False), counts, totals, m.buckets, m.stem)


def update_index(spark: SparkSession, path: str, changed: DataFrame, removed: DataFrame | None = None, id_column: str = "id", text: str = "content") -> WordIndex:
    """Puts the texts of changed in the place of what the index has of their ids, removes those of
    removed (id), and opens the result. Writes as much as changed has; of older segments two
    columns are read, for the frequencies of what goes."""
    m, version = _manifest(spark, path)
    old, name = _open(spark, path, m), f"segments/{uuid.uuid4().hex}"
    ids = changed.select(F.col(id_column).cast(m.id_type).alias("id"))
    gone = (ids if removed is None else ids.union(removed.select(F.col("id").cast(m.id_type)))).distinct()
    gone.write.parquet(f"{path}/{name}/gone")
    gone = spark.read.schema(f"id {m.id_type}").parquet(f"{path}/{name}/gone")
    lost = old.postings.select("bucket", "term", "id").join(gone, "id", "left_semi").groupBy("bucket", "term").agg((-F.count("*")).alias("df"))
    lost.select("term", "df", "bucket").write.partitionBy("bucket").parquet(f"{path}/{name}/less")
    buckets, files, spread = _dealt(changed.select(F.col(id_column).cast(m.id_type).alias(id_column), text), text)
    _write_segment(_counted(spread, id_column, text, m.stem), f"{path}/{name}", m.buckets, max(1, buckets * files // m.buckets))
    m = Manifest(m.buckets, m.stem, m.id_type, [*m.segments, name], [*m.deletes, True])
    m = _with_totals(spark, path, _folded(spark, path, m) if len(m.segments) > FOLD else m)
    _save_manifest(spark, path, m, version + 1)
    return _open(spark, path, m)


def _folded(spark: SparkSession, path: str, m: Manifest) -> Manifest:
    """All live postings as one segment. The older segments stay for who has them open."""
    rows, name = _live(spark, path, m, False).drop("bucket"), f"segments/{uuid.uuid4().hex}"
    lengths = _live(spark, path, m, True).drop("bucket")
    words = lengths.agg(F.sum("tf")).first()[0] or 0
    each = min(MOST_CHARS, max(LEAST_CHARS, 6 * words // (2 * spark.sparkContext.defaultParallelism)))  # six characters a word
    _write_segment(rows.unionByName(lengths), f"{path}/{name}", m.buckets, max(1, 6 * words // each // m.buckets))
    return Manifest(m.buckets, m.stem, m.id_type, [name], [False])


def as_index(source: DataFrame | WordIndex, id_column: str = "id", text: str = "content") -> WordIndex:
    return source if isinstance(source, WordIndex) else build_index(source, id_column, text)


def few_terms(terms: DataFrame, column: str = "term") -> list[str] | None:
    """The distinct terms of a table of queries, or None if there are more than MOST_TERMS."""
    found = [r[0] for r in terms.select(column).distinct().limit(MOST_TERMS + 1).collect()]
    return found if len(found) <= MOST_TERMS else None


def of_terms(rows: DataFrame, terms: DataFrame, known: list[str] | None, buckets: int = 1) -> DataFrame:
    """The rows (of postings or terms) of the terms of a table of queries. known: few_terms(terms)."""
    if known is None:
        wanted = terms.select("term").distinct().select(F.col("term").alias("_term"))
        return rows.join(wanted, F.col("term") == F.col("_term"), "left_semi")
    if not known:
        return rows.where(F.lit(False))
    if 1 < buckets and len(known) < buckets:  # constants, which prune folders
        rows = rows.where(F.col("bucket").isin([bucket_of(F.lit(t), buckets) for t in known]))
    return rows.where(F.col("term").isin(known))
