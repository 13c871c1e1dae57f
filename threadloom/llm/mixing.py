"""Mixing sources to target weights by balanced sampling with the cube method.

A document of a source whose target is m times its size is wanted m times in expectation:
floor(m) copies are certain, the rest is an inclusion probability. The flight phase moves the
probabilities of three documents at a time through the null space of two constraints, the
source's words and its documents, until each is 0 or 1. It runs in bounded blocks of one
source; each block leaves LANDING documents at most, most of them spread over its sizes, which
meet in fewer blocks the next round, until LANDING at most are left in a source. Landing
settles these together: the number of documents stays within one, and words miss least.

Defined results: null texts have size 0; documents of size 0 are never taken, sources of
size 0 have target 0; null is a source, the last in order; rows of equal doc_id, source and
size count as one unit of several rows (any of which may get the extra copy); random numbers
come from hashes of source and block, so reruns agree; an empty table gives an empty result;
extra columns are carried along by mix().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, free_name, materialize, text_of

#: A target stops at so many times its source's size.
MOST = 3
#: Documents in a block of the flight phase, about.
BLOCK = 2_000
#: Documents that a block's flight leaves, and that the landing of a source settles at once.
LANDING = 12
EPS = 1e-9


def size_of(column: str = "text"):
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows of source and size; one row a source.

    Sources get 1, 2, 3, 1, ... by code point order, null last, and share the whole size by
    these weights. A share above MOST times its source stops there and the excess is shared
    again: the level at which shares stop is found from running sums over the sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("weight", (F.row_number().over(names) - 1) % 3 + 1).withColumn("cap", MOST * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy(F.lit(1))
    sums = (
        ranked.withColumn("full", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("fits", F.col("cap") / F.col("weight") >= F.col("level"))
        .withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("full"), F.col("level")))).over(everyone)["level"])
    )
    return sums.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")).alias("target"))


def landing(size: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """The 0 and 1 for a few fractional documents: of all outcomes whose number of documents is
    within one of the expected number, the one whose words are nearest to the expected words."""
    n = len(size)
    outcomes = np.arange(1 << n)[:, None] >> np.arange(n) & 1
    fits = np.abs(outcomes.sum(1) - psi.sum()) <= 1 + EPS
    miss = np.where(fits, np.abs(outcomes @ size - psi @ size), np.inf)
    return outcomes[miss.argmin()].astype(float)


def last_spread(size: np.ndarray) -> np.ndarray:
    """The places of size with LANDING - 2 at most moved to the end: half of them evenly spaced
    over the places, half over the words, so that the landing has small and large documents."""
    at = (np.arange(LANDING // 2 - 1) + 0.5) / (LANDING // 2 - 1)
    words = np.cumsum(size)
    kept = np.unique(np.concatenate([(at * len(size)).astype(int), np.searchsorted(words, at * words[-1])])) if len(size) else np.arange(0)
    return np.concatenate([np.setdiff1d(np.arange(len(size)), kept), kept])


def fly(size: np.ndarray, psi: np.ndarray, rng: np.random.Generator, land: bool, left: int = 2) -> np.ndarray:
    """Inclusion probabilities after the flight, left of which at most are not 0 or 1; with
    land, none of them."""
    psi, held = psi.astype(float).tolist(), []
    sizes = size.tolist()
    draws = iter(rng.random(2 * len(psi) + 8).tolist())
    open_ = sum(EPS < x < 1 - EPS for x in psi)
    for i in range(len(psi)):
        if not EPS < psi[i] < 1 - EPS:
            psi[i] = float(round(psi[i]))
            continue
        held.append(i)
        while len(held) == 3 and open_ > left:
            a, b, c = held
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if not any(u):
                u = (1, -1, 0)
            up = min(((1 - psi[k]) if x > 0 else psi[k]) / abs(x) for k, x in zip(held, u) if x)
            down = min((psi[k] if x > 0 else (1 - psi[k])) / abs(x) for k, x in zip(held, u) if x)
            step = up if next(draws) * (up + down) < down else -down
            still = []
            for k, x in zip(held, u):
                psi[k] += step * x
                if EPS < psi[k] < 1 - EPS:
                    still.append(k)
                else:
                    psi[k] = float(round(psi[k]))
            open_ -= len(held) - len(still)
            held = still
    after = np.array(psi)
    if land and held:
        after[held] = landing(size[held], after[held])
    return after


def cube(units: DataFrame, work: Workspace) -> DataFrame:
    """units: doc_id, source, size, psi (distinct by the first three). The same with psi 0 or 1,
    in tables of the workspace."""
    schema = "doc_id long, source string, size long, psi double, block long"

    def flight(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "doc_id"], ascending=False)
        frame = frame.iloc[last_spread(frame["size"].to_numpy())]
        _, block, blocks, turn = key
        seed = xxhash.xxh3_64_intdigest(f"{key[0]!r}:{block}:{turn}")
        frame["psi"] = fly(frame["size"].to_numpy(), frame["psi"].to_numpy(), np.random.default_rng(seed), blocks == 1, LANDING)
        return frame[["doc_id", "source", "size", "psi", "block"]]

    done, turn = None, 0
    while True:
        counts = units.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).withColumnRenamed("source", "name")
        dealt = units.join(counts, F.col("source").eqNullSafe(F.col("name"))).withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(turn)), F.col("blocks")))
        moved = work.save(dealt.select("doc_id", "source", "size", "psi", "block", "blocks", F.lit(turn).alias("turn")).groupBy("source", "block", "blocks", "turn").applyInPandas(flight, schema).drop("block"), "flight")
        settled = moved.where("psi IN (0, 1)")
        done = settled if done is None else done.union(settled)
        units = moved.where("psi NOT IN (0, 1)")
        if units.isEmpty():
            return done
        turn += 1


def decisions(docs: DataFrame) -> DataFrame:
    """Each unit of docs (doc_id, source, size) with n_rows, its rows, sure, the copies of each
    row, and extra, how many of the rows get one copy more; source_size and target."""
    with Workspace(docs.sparkSession) as work:
        sizes = work.save(docs.select("doc_id", "source", size_of().alias("size")), "sizes")
        targets = work.save(source_targets(sizes), "targets").withColumnRenamed("source", "name")
        units = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows")).join(targets, F.col("source").eqNullSafe(F.col("name")))
        times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        sure = F.when(F.col("size") > 0, F.floor(times + EPS)).otherwise(0)
        units = units.withColumn("sure", sure).withColumn("more", F.when(F.col("size") > 0, F.greatest(F.col("n_rows") * (times - F.col("sure")), F.lit(0.0))).otherwise(0.0))
        units = units.withColumn("whole", F.floor(F.col("more") + EPS)).withColumn("psi", F.greatest(F.col("more") - F.col("whole"), F.lit(0.0))).drop("name", "more")
        units = work.save(units, "units")
        picked = cube(units.where(F.col("psi") > EPS).select("doc_id", "source", "size", "psi"), work).select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("psi").alias("one"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
        found = units.join(picked, same, "left").withColumn("extra", F.col("whole") + F.coalesce("one", F.lit(0.0)).cast("long"))
        return materialize(found.select("doc_id", "source", "size", "n_rows", "sure", "extra", "source_size", "target"), "decisions")


def mixture(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, copies and taken words."""
    rows = decisions(docs).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    copies = F.col("sure") + (F.col("k") <= F.col("extra")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as the mix takes it."""
    size = free_name(docs, "size")
    sized = docs.withColumn(size, size_of())
    units = decisions(docs)
    names = {c: free_name(docs, f"unit_{c}") for c in ("doc_id", "source", "size", "n_rows", "sure", "extra")}
    units = units.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & F.col("source").eqNullSafe(F.col(names["source"])) & (F.col(size) == F.col(names["size"]))
    joined = sized.join(units.hint("merge"), same)  # a decision a document: the same plan at every size
    times = free_name(docs, "times")
    once = joined.where(F.col(names["n_rows"]) == 1).withColumn(times, F.col(names["sure"]) + F.col(names["extra"]))
    # Rows of one unit: equal rows are counted first, then each group takes its part of the extra copies.
    n, upto = free_name(docs, "n"), free_name(docs, "upto")
    groups = joined.where(F.col(names["n_rows"]) > 1).groupBy(*joined.columns).agg(F.count("*").alias(n))
    unit = Window.partitionBy(names["doc_id"], names["source"], names["size"]).orderBy(F.xxhash64("text"), *[F.col(c) for c in docs.columns])
    groups = groups.withColumn(upto, F.sum(n).over(unit.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.greatest(F.lit(0), F.least(F.col(n), F.col(names["extra"]) - (F.col(upto) - F.col(n))))
    several = groups.withColumn(times, F.col(names["sure"]) * F.col(n) + part)
    rows = once.select(*docs.columns, times).union(several.select(*docs.columns, times)).where(F.col(times) > 0)
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
