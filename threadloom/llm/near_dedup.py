"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of five-word shingles, weight = tf * idf with
idf = 1 + ln(N / max(df, floor)) and floor = max(RARE * N, S / LISTED, 2), where S is the sum
of all df. Only shingles of df > floor need their df listed, and these are LISTED at most in
any corpus, so that list may be broadcast. It is exact: tasks first report the shingles that
are frequent in a window of what they read, the sums name every shingle that can be frequent,
and a second pass counts those.

Each text gets SAMPLES consistent weighted samples (Ioffe 2010). The first BANDS * ROWS form
bands; of all, four bits each are kept as a print. Candidates are texts that share all samples
of a band (a pair at the wanted similarity does, but for 6 in 100,000) and of whose samples
AGREE are equal (but for 3 in 100,000). A candidate is a link when its weighted Jaccard
similarity, computed from both whole sets, is at least SIMILARITY; classes are the connected
components.

Buckets are not expanded into all pairs. First each bucket's members meet its smallest key.
Then, in buckets that are still in several components, the members outside the largest one
meet some HEADS members of other components, and at last all that are left. Prints are
compared inside the tasks, by blocks; only close pairs leave them. So every candidate pair is
either tested or already inside one component.

Defined results: equal texts share a class (copies take part once, as one text); texts
without words, and null, are each alone in their class; a class is named by its smallest
doc_id; null doc_ids are left out of that choice where another exists; repeated rows repeat
in the result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, free_name, lean, materialize, text_key, text_of
from .shingles import counted, mix, shingles, slices

SIMILARITY = 0.8
SAMPLES, BANDS, ROWS = 384, 32, 6
#: How many samples of two prints must be equal: at similarity 0.8 it is 312 on average, with a deviation of 7.7.
AGREE = 281
#: Of one bit of each sample, how many must agree before all four are looked at: 346 on average, deviation 5.9.
AGREE_BITS = 322
#: Members of a bucket that are compared at once.
BLOCK = 4_096
#: Partners of a member that are tested before all.
HEADS = 16
#: Partners of one text that a task tests with one copy of its set.
PARTNERS = 512
#: Document frequencies under this share of the corpus count as this share.
RARE = 0.001
#: Shingles whose document frequency is listed, at most.
LISTED = 1 << 20
#: Distinct shingles of texts in a window of the first frequency pass.
WINDOW = 1 << 22
#: Bytes of text for each task of that pass: two windows of usual texts.
TASK_BYTES = 48 << 20
#: Candidate texts whose keys are broadcast (some 50 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 200_000
SEED = 41

_rng = np.random.Generator(np.random.PCG64(SEED))
#: Odd factors: of the hash that orders the shingles of each sample, and of a second one.
_FIRST, _SECOND = (_rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1) for _ in range(2))
_BAND_FACTORS = _rng.integers(1 << 62, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_NONE = np.uint32(0xFFFFFFFF)


def frequent_candidates(texts: DataFrame, text_bytes: int) -> DataFrame:
    """(shingle, n): a superset of the shingles with df > floor, with sums too low by floor / 2 at
    most; n of the null shingle is S."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty(2 * WINDOW, np.uint64)  # one array for all of the task, as many small ones leave the heap in pieces
        full = full_docs = size = docs = every = 0  # room[:full] is a whole window, the next size are those after it

        def told(ids: np.ndarray, docs: int) -> pa.RecordBatch:
            least = int(max(RARE / 4 * docs, len(ids) / LISTED / 4)) + 1
            ids.sort()
            often = ids[: len(ids) - least + 1] == ids[least - 1 :] if least <= len(ids) else np.zeros(0, bool)
            often[1:] &= ids[1 : len(often)] != ids[: max(len(often) - 1, 0)]
            first = np.flatnonzero(often)
            return pa.RecordBatch.from_arrays([pa.array(ids[first].astype(np.int64)), pa.array(np.searchsorted(ids, ids[first], "right") - first)], ["shingle", "n"])

        for batch in batches:
            for start, end, data, offsets in slices(batch.column(0)):
                ids = counted(shingles(data, offsets)[0])[1]
                if full + size + len(ids) > len(room):
                    room = np.concatenate([room[: full + size], np.empty(len(ids) + WINDOW, np.uint64)])
                room[full + size : full + size + len(ids)] = ids
                docs, size, every = docs + end - start, size + len(ids), every + len(ids)
                if size >= WINDOW:
                    if full:
                        yield told(room[:full], full_docs)
                        room[:size] = room[full : full + size].copy()
                    full, full_docs, size, docs = size, docs, 0, 0
        if full + size:  # what is left joins the last window, as a short one would report much
            yield told(room[: full + size], full_docs + docs)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([every])], ["shingle", "n"])

    # Few large tasks, for the same reason.
    few = texts.select("text").coalesce(max(1, text_bytes // TASK_BYTES))
    return few.mapInArrow(lean(windows), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def document_frequencies(texts: DataFrame, work: Workspace) -> tuple[int, float, np.ndarray, np.ndarray]:
    """N, the floor, the shingles with df > floor in ascending order and their exact df."""
    spark = texts.sparkSession
    total, text_bytes = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not total:
        return 0, 2.0, np.zeros(0, np.uint64), np.zeros(0)
    likely = work.save(frequent_candidates(texts, text_bytes), "likely")
    every = likely.where("shingle IS NULL").agg(F.sum("n")).first()[0] or 0
    floor = max(RARE * total, every / LISTED, 2)
    listed = likely.where(F.col("shingle").isNotNull() & (F.col("n") > floor / 2)).select("shingle").toPandas()  # 2 * LISTED rows at most
    known = spark.sparkContext.broadcast(np.sort(listed["shingle"].to_numpy(np.uint64)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = known.value, np.zeros(len(known.value), np.int64)
        maybe = _marks(table)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                _, ids, _ = counted(shingles(data, offsets)[0])
                ids = ids[maybe[(ids & np.uint64(0xFFFFF)).astype(np.int64)]]
                at = np.searchsorted(table, ids)
                hit = (at < len(table)) & (table[np.minimum(at, len(table) - 1)] == ids) if len(table) else np.zeros(len(ids), bool)
                n += np.bincount(at[hit], minlength=len(table))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(table[some].astype(np.int64)), pa.array(n[some])], ["shingle", "n"])

    counts = texts.select("text").mapInArrow(lean(tally), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("df")).where(F.col("df") > floor).toPandas().sort_values("shingle")
    known.unpersist()
    return total, floor, counts["shingle"].to_numpy(np.uint64), counts["df"].to_numpy(np.float64)


def _marks(ids: np.ndarray) -> np.ndarray:
    """Which low 20 bits occur: most shingles are ruled out by one look."""
    marks = np.zeros(1 << 20, bool)
    marks[(ids & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return marks


class Weights:
    """tf * idf of shingles, as float32."""

    def __init__(self, total: int, floor: float, known: np.ndarray, df: np.ndarray) -> None:
        self.known, self.marks = known, _marks(known)
        self.usual = np.float32(1 + np.log(max(total, 1) / floor))  # of a rare shingle that the text has once
        self.idf = 1 + np.log(max(total, 1) / df)

    def __call__(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = np.full(len(ids), self.usual, np.float64)
        maybe = np.flatnonzero(self.marks[(ids & np.uint64(0xFFFFF)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, ids[maybe]), len(self.known) - 1)
            hit = self.known[at] == ids[maybe]
            w[maybe[hit]] = self.idf[at[hit]]
        return (w * tf).astype(np.float32)


def _exponential(u: np.ndarray) -> np.ndarray:
    """Uniform 32-bit hashes as exponential variates, in the same order."""
    return -np.log1p(u * -(0.5**32))


def samples(ids: np.ndarray, w: np.ndarray, starts: np.ndarray, usual: np.float32) -> np.ndarray:
    """One row a sample, one column a text: a number for the chosen shingle and its t.

    Of weight w, a shingle's variate a is exponential with rate w. At the usual weight w0 it is
    taken from a hash u, so that texts of usual weights need the smallest u only. Given that a0,
    the other variates of the method follow: with e1, e2 exponential, z = w0 + e1 / a0,
    r = ln(z / w0) + e2 and ln y0 = ln z - r, another weight w has t = floor((ln w - ln y0) / r)
    steps of r and a = a0 exp(-r t). As a >= a0 (w0 / w) exp(-e2), few need to be computed.
    """
    x = (ids >> np.uint64(16)).astype(np.uint32)
    odd = np.flatnonzero(w != usual)
    light = odd[w[odd] < usual]
    out, u = np.empty((SAMPLES, len(starts)), np.uint32), np.empty_like(x)
    for k in range(SAMPLES):
        np.multiply(x, _FIRST[k], out=u)
        u[light] = _NONE
        np.minimum.reduceat(u, starts, out=out[k])
    if not len(odd):
        return out
    best = np.where(out == _NONE, np.inf, _exponential(out))
    owners = np.searchsorted(starts, odd, "right") - 1
    for at in range(0, len(odd), 2_048):
        part, owner = odd[at : at + 2_048], owners[at : at + 2_048]
        ratio = w[part].astype(np.float64) / usual
        first, second = x[part] * _FIRST[:, None], x[part] * _SECOND[:, None]
        least = first.astype(np.float32) * second.astype(np.float32) * (0.5**64 / ratio).astype(np.float32)
        near = np.flatnonzero(least <= (best * 1.001).astype(np.float32)[:, owner])
        k, i = np.divmod(near, len(part))
        first, second = first.reshape(-1)[near], second.reshape(-1)[near]
        a, e2 = _exponential(first + 0.0), -np.log((second + 0.5) * 0.5**32)
        e1 = _exponential((mix(first.astype(np.uint64) << np.uint64(32) | second) >> np.uint64(32)) + 0.0)
        r = np.log1p(e1 / np.maximum(a, 1e-300)) + e2
        t = np.floor((np.log(ratio)[i] + e2) / r)
        moved = np.flatnonzero(t)
        a[moved] *= np.exp(-r[moved] * t[moved])
        first[moved] = (mix(first[moved] + (t[moved].astype(np.int64).astype(np.uint64) << np.uint64(32))) >> np.uint64(32)).astype(np.uint32)
        cell = k * len(starts) + owner[i]  # ascending
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        if len(heads):
            lowest = np.minimum.reduceat(a, heads)
            won = np.flatnonzero(a == np.repeat(lowest, np.diff(np.append(heads, len(a)))))
            won = won[np.unique(cell[won], return_index=True)[1]]
            won = won[a[won] <= best.reshape(-1)[cell[won]]]
            best.reshape(-1)[cell[won]], out.reshape(-1)[cell[won]] = a[won], first[won]
    return out


def sketch(docs: DataFrame, model) -> DataFrame:
    """doc_id, tid, the keys of the bands, their low halves side by side, and the print of every
    document (none of them for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*model.value)
        shifts = (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :, None]
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2)):
                text, ids, tf = counted(shingles(data, offsets)[0])
                has = np.zeros(end - first, np.int64)
                keys, prints = np.zeros((0, BANDS), np.uint64), np.zeros((0, SAMPLES // 16), np.uint64)
                if len(ids):
                    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                    has[text[starts].astype(np.int64)] = 1
                    drawn = samples(ids, weights(ids, tf), starts, weights.usual).astype(np.uint64)
                    nibbles = (mix(drawn + np.uint64(1)) >> np.uint64(60)).reshape(SAMPLES // 16, 16, -1)
                    prints = (nibbles << shifts).sum(1, dtype=np.uint64).T
                    drawn = drawn[: BANDS * ROWS].reshape(BANDS, ROWS, -1)
                    keys = np.stack([mix((drawn[b] * _BAND_FACTORS[b][:, None]).sum(0, dtype=np.uint64) + np.uint64(b)) for b in range(BANDS)], 1)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * x.shape[1])]).astype(np.int32)), pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64))) for x in (keys, prints)]
                lows = np.ascontiguousarray(keys.astype(np.uint32)).tobytes()
                low = pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(has * 4 * BANDS)]).astype(np.int32)), pa.py_buffer(lows)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), lists[0], low, lists[1]], ["doc_id", "tid", "bands", "low", "print"])

    return docs.select("doc_id", "tid", "text").mapInArrow(lean(run), "doc_id long, tid binary, bands array<long>, low binary, print array<long>")


def packed(ids: np.ndarray, w: np.ndarray) -> np.ndarray:
    """40 bits of each shingle's hash above its weight, a float32 rounded to 24 bits; in ascending order as ids are."""
    return ids >> np.uint64(8) << np.uint64(24) | ((w.view(np.uint32).astype(np.uint64) + np.uint64(0x80)) >> np.uint64(8))


def unpacked(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat >> np.uint64(24), ((flat & np.uint64(0xFFFFFF)).astype(np.uint32) << np.uint32(8)).view(np.float32).astype(np.float64)


def weighted_sets(docs: DataFrame, model) -> DataFrame:
    """tid and its weighted shingles, packed in 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*model.value)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                text, ids, tf = counted(shingles(data, offsets)[0])
                both = packed(ids, weights(ids, tf))
                edges = np.searchsorted(text, np.arange(end - first + 1, dtype=np.uint64))
                sets = pa.array([both[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), sets], ["tid", "weighted"])

    return docs.select("tid", "text").mapInArrow(lean(run), "tid binary, weighted binary")


def weighted_jaccard(a: bytes | pa.Buffer, b: bytes | pa.Buffer) -> float:
    both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
    both.sort()
    ids, w = unpacked(both)
    shared = w[:-1][ids[1:] == ids[:-1]].sum()  # of two equal shingles the lighter one comes first
    return float(shared / (w.sum() - shared)) if len(both) else 0.0


def agree(p: str, q: str) -> Column:
    """How many samples of two prints are equal: of each four bits that differ, one is counted."""
    differ = " + ".join(f"bit_count(((x{i}_ | shiftrightunsigned(x{i}_, 1) | shiftrightunsigned(x{i}_, 2) | shiftrightunsigned(x{i}_, 3)) & {0x1111111111111111}L))" for i in range(SAMPLES // 16))
    for i in range(SAMPLES // 16):
        differ = differ.replace(f"x{i}_", f"({p}[{i}] ^ {q}[{i}])")
    return F.lit(SAMPLES) - F.expr(differ)


def links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least the given one.

    A text's partners are dealt into parts of some PARTNERS. A task meets each part as a run of
    rows, the text's own set first, and holds no more than that set and one batch of partners.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    partners = dealt.join(sets.withColumnRenamed("tid", "b"), "b").select("a", "part", F.lit(1).alias("turn"), "b", "weighted")
    own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets.withColumnRenamed("tid", "a"), "a").select("a", "part", F.lit(0).alias("turn"), F.col("a").alias("b"), "weighted")
    rows = own.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", "turn")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = b""
        for batch in batches:
            found = []
            for i, turn in enumerate(batch.column(2).to_pylist()):
                weighted = batch.column(4)[i].as_buffer()
                if not turn:
                    own = weighted.to_pybytes()
                elif weighted_jaccard(own, weighted) >= similarity:
                    found.append(i)
            yield batch.select([0, 3]).take(pa.array(found, pa.int64())).rename_columns(["a", "b"])

    return rows.mapInArrow(lean(test), "a binary, b binary")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node and comp, the smallest node that it is connected to. In each round every node is named
    by its smallest neighbour, or itself, and edges become edges between names; those within one
    name go. Keys are hashes, so few nodes are the smallest around and edges dwindle fast."""
    both = work.save(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = None
    while True:
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"))
        labels = work.save(near if labels is None else _renamed(labels, near), "labels")
        names = [near.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}")) for k in ("a", "b")]
        both = work.save(both.join(names[0], "a").join(names[1], "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "edges")
        if both.isEmpty():
            return labels


def _renamed(labels: DataFrame, names: DataFrame) -> DataFrame:
    """labels with their comp named anew by names (node, comp)."""
    new = names.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
    return labels.join(new, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))


def extended(labels: DataFrame, found: DataFrame, work: Workspace) -> DataFrame:
    """labels (node, comp) after more links (a, b): only these are followed, between components."""
    of = [labels.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}")) for k in ("a", "b")]
    between = found.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    names = components(between, work)
    fresh = names.join(labels.select(F.col("comp").alias("node")).distinct(), "node", "left_anti")
    return work.save(_renamed(labels, names).union(fresh.select("node", "comp")), "labels")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, tid (the key of its text), class_id and class_tid, a row for each document.
    Of the texts of the document that names the class, class_tid is the smallest key."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", text_key().alias("tid"), text_of().alias("text"))
    with Workspace(spark) as work:
        model = spark.sparkContext.broadcast(document_frequencies(keyed, work))
        sketched = work.save(sketch(keyed, model), "sketches")
        members = work.save(_shared_buckets(sketched), "buckets")
        wanted = members.select("tid").distinct()
        firsts = (
            sketched.groupBy("tid", "doc_id").agg(F.count("*").alias("n")).groupBy("tid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "n")).alias("f"))
            .join(wanted, "tid", "left_semi").select(F.col("tid").alias("want"), F.col("f.doc_id").alias("first"), F.col("f.n").alias("n"))
        )
        chosen = work.save(firsts, "candidates")
        want = F.broadcast(chosen) if chosen.count() <= BROADCAST_KEYS else chosen
        picked = keyed.join(want, (F.col("tid") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("first")))
        if not chosen.where("n > 1").isEmpty():  # repeated rows
            picked = picked.where("n = 1").union(picked.where("n > 1").dropDuplicates(["tid"]))
        sets = work.save(weighted_sets(picked, model), "sets")
        found = materialize(_classes(sketched, _labels(members, sets, similarity, work), work), "classes")
        model.unpersist()
        return found


def _shared_buckets(sketched: DataFrame) -> DataFrame:
    """bucket, tid, low, print: the texts of each bucket that holds several. Buckets of one text, the most, go first."""
    rows = sketched.select(F.explode("bands").alias("bucket"), "tid")
    several = rows.groupBy("bucket").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo < hi").select("bucket")
    prints = sketched.groupBy("tid").agg(F.first("low").alias("low"), F.first("print").alias("print"))
    return rows.join(several.hint("merge"), "bucket").distinct().join(prints, "tid")  # both grow with the corpus


def _labels(members: DataFrame, sets: DataFrame, similarity: float, work: Workspace) -> DataFrame:
    """node, comp of the texts that have links. members: bucket, tid, low, print."""
    heads = members.groupBy("bucket").agg(F.min(F.struct("tid", "print")).alias("h")).select("bucket", F.col("h.tid").alias("head"), F.col("h.print").alias("hprint"))
    star = members.join(heads, "bucket").where((F.col("tid") != F.col("head")) & (agree("print", "hprint") >= AGREE))
    tested = work.save(star.select(F.col("head").alias("a"), F.col("tid").alias("b")).distinct(), "pairs")
    labels = components(work.save(links(tested, sets, similarity), "links"), work)
    for rest in (False, True):
        members = _split(members, labels, work)
        pairs = _close_pairs(members, rest).select(F.least("tid", "head").alias("a"), F.greatest("tid", "head").alias("b")).distinct()
        fresh = work.save(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not fresh.isEmpty():
            tested, labels = tested.union(fresh), extended(labels, work.save(links(fresh, sets, similarity), "links"), work)
    return labels


def _split(members: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """members with comp, n (their bucket's members) and main (its largest component), of the buckets in several components."""
    rows = members.select("bucket", "tid", "low", "print").join(labels.withColumnRenamed("node", "tid"), "tid", "left").withColumn("comp", F.coalesce("comp", "tid"))
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("comps")).where("comps > 1").select("bucket", "n", F.col("m.comp").alias("main"))
    return work.save(rows.join(largest, "bucket"), "members")


def _close_pairs(split: DataFrame, rest: bool) -> DataFrame:
    """tid, head: close pairs of a bucket's members in different components, one of them (head)
    outside the largest: of each head, those some HEADS partners that a hash of the pair names,
    or the rest. A pair is told in the bucket of the first band that its texts share, and in no
    other. Buckets are cut into blocks of bounded size; a task takes pairs of blocks one
    after another and compares all their prints at once: first one bit of each sample by a matrix
    product, then all four bits of the pairs that this leaves."""
    counts = split.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("comp") != F.col("main")) / BLOCK).cast("int").alias("headblocks")).withColumnRenamed("bucket", "_bucket")
    rows = split.join(counts, F.col("bucket") == F.col("_bucket")).withColumn("order", F.xxhash64("tid"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod("order", F.col(n)).cast("int")
    columns = ["bucket", "block", "headblock", "is_head", "tid", "comp", "main", "n", "low", "print"]
    members = rows.withColumn("block", own("blocks")).withColumn("headblock", each("headblocks")).withColumn("is_head", F.lit(False))
    heads = rows.where("comp <> main").withColumn("headblock", own("headblocks")).withColumn("block", each("blocks")).withColumn("is_head", F.lit(True))
    key = ["bucket", "block", "headblock"]
    dealt = members.select(*columns).union(heads.select(*columns)).repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table]).combine_chunks()
            keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in key])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            left = table.slice(int(cuts[-1])) if len(cuts) else table
            if len(cuts):
                yield from _close_in(table.slice(0, int(cuts[-1])), np.concatenate([[0], cuts]), rest)
        if left is not None and len(left):
            yield from _close_in(left, np.array([0, len(left)]), rest)

    return dealt.mapInArrow(lean(run), "tid binary, head binary")


def _close_in(table: pa.Table, edges: np.ndarray, rest: bool) -> Iterator[pa.RecordBatch]:
    """The close pairs within each run of rows, edges[i] to edges[i + 1]."""
    tids = table.column("tid").combine_chunks()
    order = np.array([int.from_bytes(t[:8], "big") for t in tids.to_pylist()], np.uint64)
    comps = pa.concat_arrays([table.column(k).combine_chunks() for k in ("comp", "main")]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    comp, main, size = comps[: len(table)], comps[len(table) :], table.column("n").to_numpy()
    head = table.column("is_head").to_numpy()
    prints = table.column("print").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SAMPLES // 16)
    lows = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint32).reshape(-1, BANDS)
    bucket = table.column("bucket").to_numpy().view(np.uint64).astype(np.uint32)
    ones = np.uint64(0x1111111111111111)
    for a, b in zip(edges[:-1], edges[1:]):
        h, m = a + np.flatnonzero(head[a:b]), a + np.flatnonzero(~head[a:b])
        if not len(h) or not len(m):
            continue
        signs, outside = _signs(prints[m]), comp[m] != main[a]
        for at in range(0, len(h), 128):
            part = h[at : at + 128]
            near = (_signs(prints[part]) @ signs.T >= 2 * AGREE_BITS - SAMPLES) & (comp[part][:, None] != comp[m])
            near &= ~outside | (order[part][:, None] <= order[m])  # of two outside, one order will do
            early = mix(order[part][:, None] ^ order[m]) * 0.5**64 * size[a] < HEADS
            i, j = np.nonzero(near & (early != rest))
            for k in range(0, len(i), 1 << 16):
                x, y = part[i[k : k + (1 << 16)]], m[j[k : k + (1 << 16)]]
                differ = prints[x] ^ prints[y]
                differ |= differ >> np.uint64(1)
                differ |= differ >> np.uint64(2)
                same = SAMPLES - np.bitwise_count(differ & ones).sum(1, dtype=np.int64) >= AGREE
                x, y = x[same], y[same]
                band = (lows[x] == lows[y]).argmax(1)
                here = lows[x, band] == bucket[a]
                x, y = x[here], y[here]
                yield pa.RecordBatch.from_arrays([tids.take(pa.array(y)), tids.take(pa.array(x))], ["tid", "head"])


def _signs(prints: np.ndarray) -> np.ndarray:
    """One bit of each sample as 1 or -1."""
    bits = (prints[:, :, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4))) & np.uint64(1)
    return bits.reshape(len(prints), SAMPLES).astype(np.float32) * 2 - 1


def _classes(sketched: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    rows = sketched.select("doc_id", "tid", (F.size("bands") == 0).alias("alone"))
    rows = work.save(rows.join(labels.withColumnRenamed("node", "tid"), "tid", "left").withColumn("comp", F.coalesce("comp", "tid")), "labelled")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tid"))
    # Written first, so that the join's sides are plain shuffles, of which adaptive execution splits the hot keys.
    names = work.save(rows.where(~F.col("alone")).groupBy("comp").agg(first.alias("f")).select("comp", F.col("f.doc_id").alias("class_id"), F.col("f.tid").alias("class_tid")), "names")
    named = rows.where(~F.col("alone")).join(names, "comp").select("doc_id", "tid", "class_id", "class_tid")
    return named.union(rows.where("alone").select("doc_id", "tid", F.col("doc_id").alias("class_id"), F.col("tid").alias("class_tid")))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs, one document of each class: the smallest doc_id. Texts without words all stay."""
    key, want, cid, n = (free_name(docs, x) for x in ("tid", "want", "first_id", "copies"))
    classes = near_classes(docs, similarity)
    rows = classes.groupBy("doc_id", "tid", (F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("tid").eqNullSafe(F.col("class_tid"))).alias("stays")).agg(F.count("*").alias(n))
    gone = rows.where("NOT stays").select(F.col("doc_id").alias(cid), F.col("tid").alias(want))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    same = F.col("doc_id").eqNullSafe(F.col(cid)) & (F.col(key) == F.col(want))
    kept = docs.withColumn(key, text_key()).join(gone, same, "left_anti")
    repeated = rows.where(F.col("stays") & (F.col(n) > 1)).select(F.col("doc_id").alias(cid), F.col("tid").alias(want))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated, same, "left_anti")
    some = kept.join(repeated, same, "left_semi")
    blank = ~text_of().rlike(r"[^\x20\x09-\x0D]")
    merged = some.where(~blank).groupBy("doc_id", key).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.select(*docs.columns).union(merged.select(*docs.columns)).union(some.where(blank).select(*docs.columns))
