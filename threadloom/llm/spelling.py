"""Spelling variants by permuterm rotations.

Words are runs of letters of at least LEAST_LENGTH code points that occur LEAST_COUNT times or
more. A word w is marked as w$, and all rotations of the marked words are sorted. A rotation
that starts right behind a character ends in that character, so without its last character it
is the rotation of everything else: words that differ by one replaced character agree on it,
and for an insertion the shorter word has it as a whole rotation. Each rotation is therefore
listed twice, whole (edit = '') and as the prefix that skips its last character (edit = that
character), and a group of equal prefixes holds exactly the words that are one edit apart. A
group has at most one word a letter of the alphabet and one whole rotation, so no group is
large; a scan keeps its count and its two most frequent words, which tell each member's number
of neighbours and best neighbour without listing pairs. A character that could be left out of
a run of equal ones at several places counts at the first of them.

Words longer than LONG code points would make rotations of quadratic size. There a rotation is
the pair of digests of what is before and behind the skipped character, taken from one forward
and one backward pass, and the word is its number in code-point order.

Defined results: null and empty texts have no words; a null doc_id counts as the empty text in
the hash; repeated rows count each; texts are read whole; equal frequencies go to the smaller
word; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, materialize, text_of

#: A run of letters, as a Java pattern; × and ÷ lie within the range.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Code points and occurrences that a word has at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One code point is deleted from a run whose hash this divides.
DELETED = 31
#: A form has at least this multiple of its word's occurrences.
TIMES = 10
#: Code points of words whose rotations are written out; longer ones are rotated as digests.
LONG = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame) -> DataFrame:
    """word, n: the distinct words and how often each occurs. Runs too short to become a word
    are not listed; counts are combined in each task before they are shuffled."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_of(), F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"), F.lit(1))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.expr("substr(run, cast(pmod(h, length(run)) AS int) + 2)"))
    marked = runs.withColumn("h", h).select(F.when(F.col("h") % DELETED == 0, cut).otherwise(F.col("run")).alias("word"))
    return marked.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def rotations(found: DataFrame) -> DataFrame:
    """key, edit, before, word, n: every rotation of the marked words, whole and without its last
    character (edit); before is the character ahead of the edited one."""
    each = F.posexplode(F.expr("transform(sequence(0, length(word)), i -> concat(substr(word, i + 1), '$', left(word, i)))"))
    turned = found.where(F.length("word") <= LONG).select("word", "n", each.alias("i", "turn"))
    skipped = F.struct(F.expr("left(turn, length(turn) - 1)").alias("key"), F.right("turn", F.lit(1)).alias("edit"), F.expr("left(right(turn, 2), 1)").alias("before"))
    whole = F.struct(F.col("turn").alias("key"), F.lit("").alias("edit"), F.lit("").alias("before"))
    both = F.when(F.col("i") > 0, F.array(whole, skipped)).otherwise(F.array(whole))
    return turned.select(F.explode(both).alias("r"), "word", "n").select("r.key", "r.edit", "r.before", "word", "n")


def long_rotations(numbered: DataFrame) -> DataFrame:
    """The same of long words (word, number, n), by digests and with the number as the word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        names = ["key", "edit", "before", "word", "n"]
        for frame in frames:
            for word, number, n in zip(frame["word"], frame["number"], frame["n"]):
                size, name = len(word), f"{number:020d}"
                behind, back = [], hashlib.md5()
                for c in ["", *reversed(word)]:
                    back.update(c.encode())
                    behind.append(back.digest())
                ahead = hashlib.md5()
                for i in range(size + 1):
                    start = ahead.hexdigest()
                    rows.append((start + behind[size - i].hex(), "", "", name, n))
                    if i < size:
                        if size > LONG:
                            rows.append((start + behind[size - i - 1].hex(), word[i], word[i - 1] if i else "$", name, n))
                        ahead.update(word[i].encode())
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        yield pd.DataFrame(rows, columns=names)

    return numbered.mapInPandas(run, "key string, edit string, before string, word string, n long")


def _best(*candidates: Column) -> Column:
    """The candidate (less, word) of most occurrences, then of the smallest word."""
    return F.array_min(F.filter(F.array(*candidates), lambda c: c.isNotNull()))


def neighbours(rows: DataFrame) -> DataFrame:
    """word, n_near, best (less: minus its occurrences, word): each word's neighbours counted, and
    the most frequent, from rotations()."""
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.col("edit") == "", F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.when(F.col("edit") != "", F.struct((-F.col("n")).alias("less"), "word", "edit"))
    scanned = rows.select(
        "word", "edit", "before",
        F.count("*").over(ranked).alias("size"),
        F.count_if(F.col("edit") != "").over(ranked).alias("edits"),
        F.count_if((F.col("edit") != "") & (F.col("edit") != F.col("before"))).over(ranked).alias("inserts"),
        F.first(me).over(ranked).alias("one"), F.nth_value(me, 2).over(ranked).alias("two"),
        F.max(F.when(F.col("edit") == "", F.struct((-F.col("n")).alias("less"), "word"))).over(ranked).alias("whole"),
        F.max(F.nullif("before", F.lit(""))).over(ranked).alias("ahead"),
    ).where("size > 1")
    plain = lambda c: F.when(c.isNotNull(), F.struct(c["less"].alias("less"), c["word"].alias("word")))
    first, second = plain(F.col("one")), plain(F.col("two"))
    shorter = F.when((F.col("edit") != F.col("before")), F.col("whole"))
    of_edit = _best(F.when(F.col("one.word") == F.col("word"), second).otherwise(first), shorter)
    of_whole = F.when(F.col("one.edit") == F.col("ahead"), second).otherwise(first)
    near = F.when(F.col("edit") == "", F.col("inserts")).otherwise(F.col("edits") - 1 + shorter.isNotNull().cast("int"))
    best = F.when(F.col("edit") == "", of_whole).otherwise(of_edit)
    told = scanned.select("word", near.alias("near"), best.alias("best")).where("near > 0")
    return told.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def all_neighbours(found: DataFrame, work: Workspace) -> DataFrame:
    """word, n_near, best_word, best_n of the words that have neighbours."""
    named = lambda d: d.select("word", "n_near", F.col("best.word").alias("best_word"), (-F.col("best.less")).alias("best_n"))
    short = named(neighbours(rotations(found)))
    lengthy = found.where(F.length("word") >= LONG)
    if not lengthy.where(F.length("word") > LONG).limit(1).count():
        return short
    # A sort deals ranges to partitions in order, so these numbers rise with the words.
    numbered = work.save(lengthy.orderBy("word").withColumn("number", F.monotonically_increasing_id()), "long-words")
    name = F.format_string("%020d", "number")
    told = named(neighbours(long_rotations(numbered)))
    own, best = numbered.select(name.alias("a"), F.col("word").alias("_word")), numbered.select(name.alias("b"), F.col("word").alias("_best"))
    told = told.join(own, F.col("word") == F.col("a")).join(best, F.col("best_word") == F.col("b")).select(F.col("_word").alias("word"), "n_near", F.col("_best").alias("best_word"), "best_n")
    both = short.unionByName(told).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word"))).alias("best"))
    return named(both)


def roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """word, root of words with a form (word, form): forms are followed to the last. Each step
    has TIMES as many occurrences, so there are few; every round doubles the steps taken."""
    step = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = step.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = step.join(onward, F.col("root") == F.col("_word"), "left")
        step = work.save(moved.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
        step = step.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    with Workspace(docs.sparkSession) as work:
        found = work.save(words(docs), "words")
        near = all_neighbours(found, work)
        fit = F.col("best_n") >= TIMES * F.col("n")
        told = found.join(near.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fit, F.col("best_word")).alias("form"), F.when(fit, F.col("best_n")).alias("form_n")
        )
        told = work.save(told, "forms")
        ends = roots(told.where("form IS NOT NULL"), work).select(F.col("word").alias("_word"), "root")
        rows = told.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return materialize(rows, "variants")
