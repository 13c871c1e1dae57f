"""Substring dedup by sliding sentence spans.

A text is cut into sentences (at line ends, after . ! ? before white space, and every LONGEST
words where these do not come). Every run of
SPAN consecutive sentences that has least_words words is a span; so that no long passage of few
sentences falls between, the shortest runs of two sentences or more that reach MIN_WORDS words,
one from each sentence onwards and one back from each sentence, are spans too. A sentence by
itself is none. least_words is a parameter, SPAN_WORDS unless given: shorter runs, as "Yes. No.
Thank you.", repeat in any corpus without being copied, and stay; with 0 every run of SPAN
sentences counts.
Spans are compared without regard to white space. Of equal spans the first in corpus order
(doc_id, then place) stays; sentences covered by any other are removed.

Only hashes are joined: 96 bits of each span, its document and place. A text that equals the
text of an earlier document has no first span, so it is left out of the join and loses every
span. A repeated span's first place is found by a min that each task combines first, so a
span that a third of all documents share is no hot group, and the join back to the places is
an equi-join that adaptive execution may split.

Defined results: a null text is empty and stays null; white space between kept sentences
stays as it was; equal doc_ids are ordered by their text's hash, and equal rows count as one
document; texts are read whole; an empty table gives an empty result; extra columns are
carried along by clean(), except that its own new columns replace columns of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, text_key, text_of

SPAN = 3
SPAN_WORDS = 20
MIN_WORDS = 30
#: Words of a sentence, at most; what has no sentence ends is cut into as many.
LONGEST = 50
#: Texts whose spans are listed at once.
ROWS = 500
#: Documents (some 40 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_DOCS = 200_000

_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"[^\n]*?[.!?]+(?=\s|\Z)|[^\n]+(?=\n|\Z)")


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """Start, end, words joined by one space, and how many, of every sentence with a word; one of
    more than LONGEST words counts as several, of LONGEST words each."""
    out = []
    for m in _SENTENCE.finditer(text):
        words = m[0].split()
        if len(words) > LONGEST:
            ends = [m.start() + w.end() for w in _WORD.finditer(m[0])]
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            for k in range(0, len(words), LONGEST):
                part = words[k : k + LONGEST]
                end = ends[k + len(part) - 1]
                out.append((at, end, " ".join(part), len(part)))
                at = end
        elif words:
            out.append((m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), " ".join(words), len(words)))
    return out


def spans(found: list[tuple[int, int, str, int]], least_words: int = SPAN_WORDS) -> list[tuple[int, int]]:
    """First sentence and number of sentences of every span."""
    out, n, end, back = set(), len(found), 0, 0
    upto = [0, *accumulate(s[3] for s in found)]
    for i in range(n):
        if i + SPAN <= n and upto[i + SPAN] - upto[i] >= least_words:
            out.add((i, SPAN))
        end = max(end, i + 2)
        while end < n and upto[end] - upto[i] < MIN_WORDS:
            end += 1
        if end <= n and upto[end] - upto[i] >= MIN_WORDS:
            out.add((i, end - i))
        while back + 2 <= i and upto[i + 1] - upto[back + 1] >= MIN_WORDS:
            back += 1
        if back < i and upto[i + 1] - upto[back] >= MIN_WORDS:
            out.add((back, i + 1 - back))
    return sorted(out)


def span_rows(docs: DataFrame, least_words: int = SPAN_WORDS) -> DataFrame:
    """h1, h2 (hash), doc_id, tid, first, n of every span of docs (doc_id, tid, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), ROWS):
                frame = whole.iloc[at : at + ROWS]
                h1, h2, row, first, size = [], [], [], [], []
                for k, text in enumerate(frame["text"]):
                    found = sentences(text)
                    for i, n in spans(found, least_words):
                        h = xxhash.xxh3_128_intdigest(" ".join(s[2] for s in found[i : i + n]))
                        h1.append((h & (2**64 - 1)) - 2**63)
                        h2.append((h >> 64 & (2**32 - 1)) - 2**31)
                        row.append(k)
                        first.append(i)
                        size.append(n)
                yield pd.DataFrame({"h1": h1, "h2": h2, "doc_id": frame["doc_id"].astype("Int64").iloc[row].to_numpy(), "tid": frame["tid"].iloc[row].to_numpy(), "first": first, "n": size})

    return docs.mapInPandas(run, "h1 long, h2 int, doc_id long, tid long, first int, n int")


def copies(keyed: DataFrame) -> DataFrame:
    """doc, tid, head: documents whose text an earlier document has, with that document's id."""
    pairs = keyed.select("doc_id", "key").distinct()
    firsts = pairs.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("f"), F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("_key"), F.col("f.doc_id").alias("head"))
    rows = pairs.join(firsts, F.col("key") == F.col("_key")).where(~F.col("doc_id").eqNullSafe(F.col("head")))
    return rows.select(F.col("doc_id").alias("_doc"), "_key", "head")


def repeated(keyed: DataFrame, least_words: int = SPAN_WORDS) -> DataFrame:
    """From doc_id, key (of the text) and text: _doc, _key, found (first sentence and length of
    each span that is a non-first repeat; null for copies of whole texts) and first_ids (the
    documents that hold the first ones), for the documents that have any."""
    whole = materialize(copies(keyed), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))
    few = whole.count() <= BROADCAST_DOCS
    own = keyed.join(F.broadcast(whole) if few else whole, same, "left_anti")
    rows = materialize(span_rows(own.select("doc_id", F.xxhash64("key").alias("tid"), "text"), least_words), "spans")
    place = F.struct("doc_id", "tid", "first")
    # Written first, so that the join's sides are plain shuffles, of which adaptive execution splits the hot keys.
    heads = materialize(rows.groupBy("h1", "h2").agg(F.min(place).alias("lo"), F.count("*").alias("c")).where("c > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "lo"), "heads")
    later = rows.join(heads, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(place > F.col("lo"))
    some = later.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("first", "n")).alias("found"), F.array_sort(F.collect_set("lo.doc_id")).alias("first_ids"))
    keys = own.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.xxhash64("key").alias("_tid")).distinct()
    spans_of = some.join(keys, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tid") == F.col("_tid"))).select("_doc", "_key", "found", "first_ids")
    none = F.lit(None).cast(spans_of.schema["found"].dataType)
    return spans_of.union(whole.select("_doc", "_key", none, F.when(F.col("head").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("head"))))


def _without(text: str, removed: set[int]) -> str:
    parts, at = [], 0
    for i, (_, end, _, _) in enumerate(sentences(text)):
        if i not in removed:
            parts.append(text[at:end])
        at = end
    return "".join([*parts, text[at:]]).strip() if removed else text


def clean(docs: DataFrame, least_words: int = SPAN_WORDS) -> DataFrame:
    """docs with text cleaned, n_sentences, n_removed and first_ids."""
    names = {c: free_name(docs, f"span_{c.strip('_')}_{i}") for i, c in enumerate(("key", "_doc", "_key", "found", "first_ids", "hit"))}
    gone = materialize(repeated(docs.select("doc_id", text_key().alias("key"), text_of().alias("text")), least_words), "repeated")
    gone = gone.select(*[F.col(c).alias(names[c]) for c in ("_doc", "_key", "found", "first_ids")], F.lit(True).alias(names["hit"]))
    joined = docs.withColumn(names["key"], text_key()).join(gone, F.col("doc_id").eqNullSafe(F.col(names["_doc"])) & (F.col(names["key"]) == F.col(names["_key"])), "left")

    @F.pandas_udf("text string, n_sentences int, n_removed int")
    def cut(texts: pd.Series, found: pd.Series, hit: pd.Series) -> pd.DataFrame:
        out = []
        for t, f, h in zip(texts, found, hit):
            own = [] if t is None else sentences(t)
            runs = [] if h is None or h is pd.NA or h != True else spans(own, least_words) if f is None else [(x["first"], x["n"]) for x in f]  # noqa: E712
            gone = {k for i, n in runs for k in range(i, i + n)}
            out.append((None if t is None else _without(t, gone), len(own), len(gone)))
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])

    cleaned = free_name(docs, "cut")
    result = joined.withColumn(cleaned, cut("text", names["found"], names["hit"]))
    new = ("n_sentences", "n_removed", "first_ids")
    return result.select(
        *[F.col(f"{cleaned}.text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c.lower() not in new],
        f"{cleaned}.n_sentences", f"{cleaned}.n_removed", F.coalesce(names["first_ids"], F.array().cast("array<bigint>")).alias("first_ids"),
    )
