"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from built-in functions, one pass over every whole text. The trees are
fitted on at most MAX_TRAIN labelled documents and flattened into arrays; every document is
then scored in Arrow batches. Labels are used for fitting only, from documents whose
crc32(doc_id as text) mod 3 is not 1; lang, source and doc_id are no features.

Defined results: null text counts as empty and is scored; a null doc_id is not held out and
has no label; null labels are ignored; of several labels of a document each counts; repeated
rows are scored alike; without labels of both classes the score is their (smoothed) share;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, calibrated
from .common import materialize
from .quality_rules import with_statistics

#: Labelled documents that the trees are fitted on, about, at most (chosen by hash); rows of theirs,
#: where labels or documents repeat, twice as many.
MAX_TRAIN = 20_000

#: Features, as expressions over the statistics.
FEATURES = {
    "log_words": "ln(1 + n_words)",
    "log_lines": "ln(1 + n_lines)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "distinct_ratio": "n_distinct_words / greatest(n_words, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
    "punctuation_ratio": "n_punctuation / greatest(n_words, 1)",
    "stop_ratio": "n_stops / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES, as doubles."""
    counted = with_statistics(docs.select("doc_id", "text"), distinct=True)
    counted = counted.withColumn("n_digits", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[0-9]")))
    counted = counted.withColumn("n_punctuation", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[,;:!?]")))
    counted = counted.withColumn("n_stops", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\.")))
    return counted.select("doc_id", *[F.expr(v).cast("double").alias(k) for k, v in FEATURES.items()])


def train(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """stats: features(). labels: doc_id, quality."""
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality").where(~held_out())
    n = usable.count()
    share = min(1.0, max_train / max(n, 1))
    few = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else usable
    # The first by hash, so that repeated rows too are the same on every run.
    rows = few.join(stats, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES, "quality").limit(2 * max_train).toPandas().sort_values(["doc_id", *FEATURES])
    x, y = rows[list(FEATURES)].to_numpy(np.float64), rows["quality"].to_numpy(np.float64)
    return calibrated(x, y, rows["doc_id"].to_numpy(np.int64) * 7919 % 3)[0]


def score(stats: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score, predicted."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = sent.value.predict(frame[list(FEATURES)].to_numpy(np.float64))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return stats.mapInPandas(run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    stats = materialize(features(docs), "features")
    return score(stats, train(stats, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
