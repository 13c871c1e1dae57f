"""Quality rules whose cutoffs adapt to each language and source.

Every document gets a few statistics (built-in functions only). Their distributions are kept
as log-bucket quantile sketches: a value falls into bucket ceil(log(x) / log(GAMMA)), a sketch
is the count of each bucket, and two sketches merge by adding counts. Merging is exact and
does not depend on order, so reruns and retried tasks agree, and a quantile read from a
sketch is within 1 % of the true value.

A ratio fails above its fence q75 + 3 * max(q75 - q25, q90 - q75) by more than STEPS times its
step: what one more event (a symbol, a repeated line, one repeated window of five words) adds
to a document of this size, or of the median size if that is smaller. So where most documents
have no event at all, single ones are no ground for rejection, and the limit still follows the
sketches. Mean word length has a fence on either side and STEPS of its standard error, taken as
half the median over the square root of the number of words.

The quantiles of a (language, source) group are drawn towards those of its language, and these
towards those of all, by the weight of PRIOR documents; so small groups lean on larger ones by
degrees and no size is treated differently.

Defined results: a null text counts as empty, so it fails the base rule; null languages and
sources are groups of their own; repeated rows are judged one by one and alike; an empty table
gives an empty result. Extra columns are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, text_of

#: Ratio between neighbouring bucket bounds: quantiles are within 1 %.
GAMMA = 1.02
#: Documents that the quantiles of the next larger group count for.
PRIOR = 200
#: Values under this share bucket ZERO.
SMALLEST = 1e-4
ZERO = -10_000
#: Events, or standard errors, beyond the fence that are no ground for rejection.
STEPS = 3
#: Up to so many (language, source) groups the fences are broadcast (some 100 bytes each);
#: more of them are joined by a salted shuffle.
BROADCAST_GROUPS = 50_000
SALTS = 32

#: The words of _t. Splitting at one plain character is several times faster than a pattern.
_WORDS = r"array_remove(split(replace(replace(replace(replace(replace(_t, '\n', ' '), '\t', ' '), '\r', ' '), '\u000b', ' '), '\u000c', ' '), ' '), '')"

#: Words in five-word windows that occur twice or more. Windows are compared as 64-bit hashes;
#: only texts with two equal hashes sort them. p holds the starts of repeated windows in
#: order; each covers five words, or as many as up to the next start.
_REPEATS = """
CASE WHEN n_words < 6 THEN 0L ELSE
transform(array(transform(_w, x -> xxhash64(x))), g ->
 transform(array(transform(sequence(0, size(g) - 5), i -> xxhash64(g[i], g[i+1], g[i+2], g[i+3], g[i+4]))), h ->
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
   transform(array(sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
    transform(array(sort_array(transform(
      filter(sequence(0, size(s) - 1), j -> coalesce(get(s, j - 1).x = s[j].x, false) OR coalesce(get(s, j + 1).x = s[j].x, false)),
      j -> s[j].i))), p ->
     5L + aggregate(sequence(1, size(p) - 1), 0L, (a, k) -> a + least(5, p[k] - p[k-1]))
    )[0])[0] END)[0])[0] END
"""


def with_statistics(docs: DataFrame, distinct: bool = False) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper,
    base_failed; with distinct also n_distinct_words."""
    counted = (
        docs.withColumn("_t", text_of())
        .withColumn("_w", F.expr(_WORDS))
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_upper", F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long"))
        .withColumn("_l", F.expr(r"transform(array(filter(split(_t, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')), l -> named_struct('n', size(l), 'd', size(array_distinct(l))))[0]"))
        .withColumn("n_lines", F.col("_l.n").cast("long"))
        .withColumn("n_dup_lines", (F.col("_l.n") - F.col("_l.d")).cast("long"))
        .withColumn("n_repeat_words", F.expr(_REPEATS))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )
    if distinct:
        counted = counted.withColumn("n_distinct_words", F.size(F.array_distinct("_w")).cast("long"))
    return counted.drop("_t", "_w", "_l")


#: The judged ratios: numerator, denominator and what one event adds to the numerator.
PARTS = {
    "symbol_ratio": ("n_symbols", "n_words", 1),
    "upper_ratio": ("n_upper", "word_chars", 1),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 1),
    "repeat_ratio": ("n_repeat_words", "n_words", 10),
    "word_length": ("word_chars", "n_words", 0),
}
RATIOS = {k: f"{a} / greatest({b}, 1)" for k, (a, b, _) in PARTS.items()}
#: What is sketched: the ratios and the sizes they refer to.
SKETCHED = RATIOS | {b: f"double({b})" for _, b, _ in PARTS.values()}


def sketch(stats: DataFrame, keys: list[str], ratios: dict[str, str] = SKETCHED) -> DataFrame:
    """Quantile sketches: one row for each group, ratio and bucket that occurs, with its count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), F.expr(v).cast("double").alias("x")) for k, v in ratios.items()]))
    bucket = F.when(F.col("r.x") < SMALLEST, ZERO).otherwise(F.ceil(F.log(F.col("r.x")) / math.log(GAMMA)).cast("int"))
    return stats.select(*keys, pairs.alias("r")).groupBy(*keys, F.col("r.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups, by adding counts."""
    return sketches.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys, ratio, total and one column for each wanted quantile. A group has some thousand
    buckets at most, however many rows it counts."""
    group = Window.partitionBy(*keys, "ratio")
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
    ranked = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group))
    return ranked.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), *[F.min(F.when(F.col("upto") >= q * F.col("total"), value)).alias(name) for name, q in at.items()])


def fences(sketches: DataFrame) -> DataFrame:
    """lang, source and for each ratio its fences and the median of its size."""
    at = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}
    levels = [quantiles(merge(sketches, keys), keys, at) for keys in (["lang", "source"], ["lang"], [])]
    fine, lang, whole = (q.select(*[c for c in q.columns if c in ("lang", "source")], "ratio", F.struct("total", *at).alias(f"s{i}")) for i, q in enumerate(levels))
    joined = (
        fine.alias("f")
        .join(lang.alias("l"), F.col("f.lang").eqNullSafe(F.col("l.lang")) & (F.col("f.ratio") == F.col("l.ratio")))
        .join(F.broadcast(whole.alias("w")), F.col("f.ratio") == F.col("w.ratio"))  # one row a ratio
        .select("f.lang", "f.source", "f.ratio", "s0", "s1", "s2")
    )
    drawn = lambda own, k, prior: (F.col(f"{own}.total") * F.col(f"{own}.{k}") + PRIOR * prior) / (F.col(f"{own}.total") + PRIOR)
    q = {k: drawn("s0", k, drawn("s1", k, F.col(f"s2.{k}"))) for k in at}
    bounds = joined.select(
        "lang", "source", "ratio", q["q50"].alias("middle"),
        (q["q75"] + 3 * F.greatest(q["q75"] - q["q25"], q["q90"] - q["q75"])).alias("high"), (q["q25"] - 3 * F.greatest(q["q75"] - q["q25"], q["q25"] - q["q10"])).alias("low"),
    )
    return bounds.groupBy("lang", "source").agg(*[F.max(F.when(F.col("ratio") == k, F.col(b))).alias(f"{k}_{b}") for k in SKETCHED for b in ("high", "low", "middle")])


def judge(stats: DataFrame) -> DataFrame:
    """stats (with_statistics, already written: it is read twice) with kept."""
    bounds = materialize(fences(sketch(stats, ["lang", "source"])), "fences").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if bounds.count() <= BROADCAST_GROUPS:
        joined = stats.join(F.broadcast(bounds), same, "left")
    else:
        salted = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = stats.withColumn("_spread", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_spread") == F.col("_salt")), "left").drop("_salt", "_spread")
    within = F.lit(True)
    for k, (_, size, unit) in PARTS.items():
        step = f"{unit} / least(greatest({size}, 1), greatest({size}_middle, 1))" if unit else f"0.5 * {k}_middle / sqrt(greatest({size}, 1))"
        within = within & F.expr(f"{RATIOS[k]} <= {k}_high + {STEPS} * {step}")
        if not unit:
            within = within & F.expr(f"{RATIOS[k]} >= {k}_low - {STEPS} * {step}")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True))).drop("_lang", "_source", *[c for c in bounds.columns if c.endswith(("_high", "_low", "_middle"))])


#: What the query returns beside doc_id.
DIGEST = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the statistics, base_failed, kept."""
    stats = materialize(with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "statistics")
    return judge(stats).select("doc_id", *DIGEST, "n_lines", "n_upper")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with docs' own columns. The texts are written once with
    their statistics; the sketches then read only the statistics' columns."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source")}
    stats = materialize(with_statistics(docs.withColumnsRenamed(own)), "statistics")
    kept = judge(stats).where("kept")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
