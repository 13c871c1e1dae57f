"""Toxicity classifier: a convolutional network over hashed word embeddings, in numpy.

A word's embedding is the mean of rows of one hashed table: that of the whole word and those of
its beginnings, so that inflected and compounded forms share what their stem has taught. Filters
of WIDTHS neighbouring words run over the whole text, each keeps its largest value, and a linear
layer over these gives log odds. The table starts from each row's smoothed evidence, the log
ratio of toxic and other texts that have it, counted over all labelled texts, so that the first
maxima already fall on telling words. From there on texts are dealt by hash into shards of some
SHARD texts; tasks fit one network to each shard by minibatch Adagrad, and the network is the
mean of theirs, of a table's row that of the shards that changed it. Means are taken in exact
integers, so neither partitions nor the order of rows change them.

Every labelled text that is not held out counts: a fifth of them (by hash) is kept out of the
fitting, and on all of these the thresholds are calibrated by language, in steps of 1 / STEPS. The
language is guessed from the text's own function words, as the column lang is no input; texts
that show none form a group of their own, and small groups lean on the threshold of all. The
score is the probability shifted so that its group's threshold lies at 0.5.

Every word of every text is scored, in tasks, by Arrow batches: of a filter each word adds one
vector a place, so a convolution is a sum of table rows. Rows of new words are kept by each task,
up to CACHE of them.

Defined results: a null text counts as empty; a text without words gets the log odds of no
evidence; a null doc_id is not held out and has no label; null labels are ignored; of several
labels of a document each counts; repeated rows are scored alike; without labels of both
classes the score is their (smoothed) share; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_of

#: Texts of a shard, about.
SHARD = 4_096
#: Labels that are broadcast, at most; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Steps of a log odd in calibration, and the log odds beyond which it tells none apart.
STEPS, FAR = 1024, 64
#: Steps of one in the means of shards.
UNIT = 1 << 30
#: Rows and columns of the embedding table, widths of the filters, filters of each width.
TABLE, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 4
#: Lengths of the beginnings of a word that have a row of their own.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Every so many of the labelled texts is kept out of fitting, for the thresholds.
CALIBRATION = 5
#: Labelled texts that the threshold of all counts for in a language's.
PRIOR = 20
#: Words whose rows a task keeps.
CACHE = 400_000
#: Texts scored at once, and words of a text.
ROWS, PIECE = 256, 1 << 16

_WORD = re.compile(r"\w+")
# Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "that", "is", "was", "with", "for", "this", "from"),
    "de": ("der", "die", "und", "den", "das", "ist", "mit", "nicht", "von", "zu", "auf"),
    "fr": ("le", "les", "des", "et", "est", "dans", "pour", "une", "avec", "pas", "sur"),
    "es": ("el", "los", "las", "del", "que", "por", "una", "con", "para", "como", "al"),
}
LANGUAGES = (*FUNCTION_WORDS, "")
_LANGUAGE_OF = {w: i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_rows(word: str) -> list[int]:
    """The rows of the embedding table that a word's embedding is the mean of."""
    data, ends = word.encode(), BEGINNINGS[: max(0, len(word) - BEGINNINGS[0] + 1)]
    begins = [data[:n] for n in ends] if len(data) == len(word) else [word[:n].encode() for n in ends]
    return [zlib.crc32(b"$", zlib.crc32(data)) % TABLE, *[zlib.crc32(b) % TABLE for b in begins]]


class Rows:
    """The table rows of a list of words, one word's behind the other's."""

    def __init__(self, words: Iterable[str]) -> None:
        flat, start = array("i"), array("q", [0])
        for w in words:
            flat.extend(word_rows(w))
            start.append(len(flat))
        self.flat, self.start = np.frombuffer(flat, np.int32), np.frombuffer(start, np.int64)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i + 1]]

    def of(self, places: np.ndarray) -> Rows:
        """Those of some of the words."""
        some, size = Rows(()), self.start[places + 1] - self.start[places]
        some.start = np.r_[0, np.cumsum(size)]
        some.flat = self.flat[np.repeat(self.start[places] - some.start[:-1], size) + np.arange(some.start[-1])]
        return some


@dataclass
class Network:
    table: np.ndarray
    #: By width: (width, DIM, FILTERS) and their offsets.
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    #: Weights of the maxima of all filters, and the offset of the log odds.
    out: np.ndarray
    base: float
    #: Threshold (in log odds) of each of LANGUAGES.
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def flat(self) -> np.ndarray:
        """All parameters but the thresholds in rows of DIM, the table's first."""
        rest = np.concatenate([*(p.ravel() for p in (*self.filters, *self.offsets, self.out)), [self.base]])
        return np.vstack([self.table, np.r_[rest, np.zeros(-len(rest) % DIM)].reshape(-1, DIM)])

    def with_flat(self, flat: np.ndarray) -> Network:
        """A network of this shape with other parameters."""
        rest, at, own = flat[TABLE:].ravel(), 0, []
        for p in (*self.filters, *self.offsets, self.out):
            own.append(rest[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        k = len(self.filters)
        return Network(flat[:TABLE].copy(), own[:k], own[k : 2 * k], own[-1], float(rest[at]), self.thresholds)

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """What each word (its embedding) adds to every filter at every place: one row a word."""
        # Summed component by component: a matrix product's last digit depends on how many words it has.
        return np.hstack([sum(vectors[:, d, None] * f[i, d] for d in range(f.shape[1])) for f in self.filters for i in range(len(f))]).astype(np.float32)

    def embedded(self, rows: Rows) -> np.ndarray:
        return np.add.reduceat(self.table.take(rows.flat, 0), rows.start[:-1], axis=0) / np.diff(rows.start)[:, None]

    def responses(self, shares: np.ndarray) -> list[np.ndarray]:
        """Values of each width's filters at every place of one text (shares: projected rows of
        its words). Behind the text's ends there is nothing, so short texts have places too."""
        out, at = [], 0
        for f, b in zip(self.filters, self.offsets):
            width, n = len(f), f.shape[2]
            total = np.tile(b, (len(shares) + width - 1, 1))
            for i in range(width):  # the word at place p of a window is its (width - 1 - i)-th from the end
                total[width - 1 - i : width - 1 - i + len(shares)] += shares[:, at : at + n]
                at += n
            out.append(total)
        return out

    def log_odds(self, shares: np.ndarray) -> float:
        if not len(shares):
            return self.base
        return float(self.base + np.maximum(np.concatenate([r.max(0) for r in self.responses(shares)]), 0) @ self.out)


def _evidence(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Smoothed log ratio of the toxic (a) and other (b) texts that have a row."""
    ratio = np.log((a + 5 * share) / (b + 5 * (1 - share)) * (1 - share) / share)
    return np.where(a + b > 1, ratio, 0.0)  # a row of one text tells nothing


class Coded:
    """Texts as the numbers of their words, of which each is kept once."""

    def __init__(self, texts: Iterable[list[str]]) -> None:
        number: dict[str, int] = {}
        self.texts = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int32, len(t)) for t in texts]
        self.rows = Rows(number)


def evidence(coded: Coded, toxic: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Toxic and other texts (two columns) that have each row of the table; last, all texts."""
    counts = np.zeros((TABLE + 1, 2), np.int64)
    for c, t, n in zip(coded.texts, toxic, times):
        counts[np.unique(coded.rows.of(np.unique(c)).flat), 1 - t] += n
        counts[TABLE, 1 - t] += n
    return counts


def started(counts: np.ndarray, seed: int = 11) -> Network:
    """The network before fitting. One class or no texts give the (smoothed) share."""
    rng, (a, b) = np.random.default_rng(seed), counts[TABLE].tolist()
    share = (a + 0.5) / (a + b + 1)
    net = Network(np.zeros((TABLE, DIM)), [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), float(np.log(share / (1 - share))))
    if a and b:
        net.table[:] = rng.normal(0, 0.01, net.table.shape)
        net.table[:, 0] = _evidence(counts[:TABLE, 0], counts[:TABLE, 1], a / (a + b))
        for f in net.filters:
            f[:, 0, :] = np.abs(f[:, 0, :]) + 0.5 / len(f)
        net.out[:] = 1.0 / len(net.out)
        net.base = -2.0
    return net


def fit(coded: Coded, toxic: np.ndarray, epochs: int = 4, batch: int = 32, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> Network:
    """toxic: 0 or 1 of each text. One class or no texts give the (smoothed) share."""
    times = np.ones(len(toxic), np.int64)
    counts = evidence(coded, toxic, times)
    return descend(started(counts, seed), coded, toxic, times, counts[TABLE], epochs, batch, rate, decay, seed)


def descend(start: Network, coded: Coded, toxic: np.ndarray, times: np.ndarray, classes: np.ndarray, epochs: int = 4, batch: int = 32, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> Network:
    """start, fitted to texts that count times each; classes: toxic and other texts there are in all."""
    net, rng, n = start.with_flat(start.flat()), np.random.default_rng(seed), len(coded.texts)
    if not (n and classes.all()):
        return net
    share = (classes[0] + 0.5) / (classes.sum() + 1)
    heavy = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)) * times  # both classes weigh the same
    size = np.array([len(t) for t in coded.texts])
    state = [np.full_like(p, 0.1) for p in (net.table, *net.filters, *net.offsets, net.out)]
    base_state = 0.1
    for epoch in range(epochs):
        order, step = rng.permutation(n), rate / (1 + epoch)
        for first in range(0, n, batch):
            chosen = order[first : first + batch]
            chosen = chosen[size[chosen] > 0]
            if not len(chosen):
                continue
            # Long texts are taken apart from others: some PIECE words at once.
            runs = np.split(chosen, np.flatnonzero(np.diff(np.cumsum(size[chosen]) // PIECE)) + 1)
            found = [_gradient(net, coded, run, heavy[run], toxic[run]) for run in runs]
            touched, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            gt = decay * net.table[touched]
            np.add.at(gt, place, np.concatenate([f[1] for f in found]))
            state[0][touched] += gt**2
            net.table[touched] -= step * gt / np.sqrt(state[0][touched])
            for p, s, *gs in zip((*net.filters, *net.offsets, net.out), state[1:], *(f[2] for f in found)):
                s += sum(gs) ** 2
                p -= step * sum(gs) / np.sqrt(s)
            g_base = sum(f[3] for f in found)
            base_state += g_base**2
            net.base -= step * g_base / np.sqrt(base_state)
    return net


def _gradient(net: Network, coded: Coded, chosen: np.ndarray, heavy: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """Of the weighted loss of some texts, none of them empty: table rows and their gradients (rows
    may repeat), those of filters, offsets and out, and that of base."""
    gap, texts = max(WIDTHS) - 1, [coded.texts[i] for i in chosen]
    size = np.array([len(t) for t in texts])
    seen, place = np.unique(np.concatenate(texts), return_inverse=True)
    own = coded.rows.of(seen)
    vectors = np.vstack([np.zeros((1, DIM)), net.embedded(own)])  # the first is that of a gap
    # One text's words behind the other's, with gaps between and around them.
    before = np.cumsum(size) - size
    begin = before + gap * np.arange(1, len(size) + 1)
    line = np.zeros(size.sum() + gap * (len(size) + 1), np.int64)
    line[np.arange(size.sum()) + np.repeat(begin - before, size)] = place + 1
    shares = vectors @ np.hstack([f[j] for f in net.filters for j in range(len(f))])
    at = np.empty((len(size), len(net.out)), np.int64)
    tops = np.empty(at.shape)
    k = column = 0
    for f, offset in zip(net.filters, net.offsets):
        width, n = len(f), f.shape[2]
        values = np.tile(offset, (len(line) - width + 1, 1))
        for j in range(width):
            values += shares[:, column : column + n].take(line[j : j + len(values)], 0)
            column += n
        for i, (a, b) in enumerate(zip(begin - width + 1, begin + size)):
            at[i, k : k + n] = a + values[a:b].argmax(0)
        tops[:, k : k + n] = values[at[:, k : k + n], np.arange(n)]
        k += n
    active = np.maximum(tops, 0)
    d = heavy * (1 / (1 + np.exp(-np.clip(net.base + active @ net.out, -30, 30))) - toxic)
    dk = d[:, None] * net.out * (tops > 0)
    g_filters, g_words, k = [np.zeros_like(f) for f in net.filters], np.zeros_like(vectors), 0
    for f, g in zip(net.filters, g_filters):
        n = f.shape[2]
        for j in range(len(f)):
            words, part = line[at[:, k : k + n] + j], dk[:, k : k + n]
            g[j] = np.einsum("tn,tnd->dn", part, vectors[words])
            np.add.at(g_words, words.ravel(), (part[:, :, None] * f[j].T).reshape(-1, DIM))
        k += n
    touched = np.flatnonzero(g_words[1:].any(1))
    some = own.of(touched)
    shared = np.diff(some.start)
    g_rows = np.repeat(g_words[1 + touched] / shared[:, None], shared, axis=0)
    return some.flat, g_rows, [*g_filters, *np.split(dk.sum(0), len(WIDTHS)), d @ active], float(d.sum())


def threshold(odds: np.ndarray, toxic: np.ndarray, prior: float | None = None, times: np.ndarray | None = None) -> float:
    """Log odds that part the classes with the fewest (equally weighted) errors, in the middle of
    the widest gap that does; drawn towards prior where there are few texts of either class.
    times: how often each counts."""
    if not len(odds) or toxic.min() == toxic.max():
        return 0.0 if prior is None else prior
    o = np.argsort(odds, kind="stable")
    x, t, n = odds[o], toxic[o], np.ones(len(o), np.int64) if times is None else times[o]
    bad, good = np.cumsum(t * n), np.cumsum((1 - t) * n)
    wrong = np.r_[0, bad] / bad[-1] + np.r_[good[-1], good[-1] - good] / good[-1]
    edges = np.r_[x[0] - 1, (x[1:] + x[:-1]) / 2, x[-1] + 1]
    gaps = np.r_[1, np.diff(x), 1]
    wrong[gaps == 0] = np.inf  # equal log odds can't be parted
    gaps[wrong > wrong.min() + 1e-12] = -1
    own, few = float(edges[gaps.argmax()]), float(min(bad[-1], good[-1]))
    return own if prior is None else (few * own + PRIOR * prior) / (few + PRIOR)


def _words(texts: Iterable[str]) -> list[list[str]]:
    return [_WORD.findall(t.lower()) for t in texts]


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, times, fitted, h of every labelled text that is not held out: repeated rows
    and labels are one row that counts several times. fitted: false if it is kept for the thresholds."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id", "toxic").agg(F.count("*").alias("times"))
    if usable.count() <= BROADCAST_LABELS:
        usable = F.broadcast(usable)
    rows = docs.select("doc_id", text_of().alias("text")).join(usable, "doc_id").groupBy("doc_id", "text", "toxic").agg(F.sum("times").alias("times"))
    part = F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string")).cast("binary")) % CALIBRATION
    return rows.select("doc_id", "text", F.col("toxic").cast("long").alias("toxic"), "times", (part != 0).alias("fitted"), F.xxhash64("doc_id", "text", "toxic").alias("h"))


def counted(rows: DataFrame) -> np.ndarray:
    """evidence() of all rows of examples()."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((TABLE + 1, 2), np.int64)
        for whole in frames:
            for at in range(0, len(whole), 8 * ROWS):
                frame = whole.iloc[at : at + 8 * ROWS]
                counts += evidence(Coded(_words(frame["text"])), frame["toxic"].to_numpy(), frame["times"].to_numpy())
        row = np.flatnonzero(counts.any(1))
        yield pd.DataFrame({"row": row, "a": counts[row, 0], "b": counts[row, 1]})

    sums = rows.select("text", "toxic", "times").mapInPandas(run, "row long, a long, b long").groupBy("row").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    counts = np.zeros((TABLE + 1, 2), np.int64)
    counts[sums["row"].to_numpy(np.int64)] = sums[["a", "b"]].to_numpy(np.int64)
    return counts


def averaged(rows: DataFrame, start: Network, classes: np.ndarray, shards: int) -> Network:
    """The mean of the networks that are fitted to each shard of the rows, from start on."""
    sent = rows.sparkSession.sparkContext.broadcast(start)
    names = [f"d{i}" for i in range(DIM)]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "doc_id", "text", "toxic"])
        times = frame["times"].to_numpy()
        net = descend(sent.value, Coded(_words(frame["text"])), frame["toxic"].to_numpy(), times, classes)
        change = net.flat() - sent.value.flat()
        row = np.flatnonzero(change.any(1) | (np.arange(len(change)) >= TABLE))
        out = pd.DataFrame(np.rint(change[row] * len(frame) * UNIT).astype(np.int64), columns=names)
        return out.assign(row=row, n=len(frame))[["row", "n", *names]]

    dealt = rows.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInPandas(run, ", ".join(f"{c} long" for c in ("row", "n", *names)))
    sums = dealt.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).toPandas()
    flat = start.flat()
    flat[sums["row"].to_numpy(np.int64)] += sums[names].to_numpy(np.float64) / sums[["n"]].to_numpy(np.float64) / UNIT
    return start.with_flat(flat)


def calibrated(rows: DataFrame, net: Network) -> Network:
    """net with the thresholds that suit the rows; of their log odds only counts by step leave the tasks."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for whole in frames:
            for at in range(0, len(whole), ROWS):
                frame = whole.iloc[at : at + ROWS]
                odds, language = scorer.scores(_words(frame["text"]))
                yield pd.DataFrame({"language": language, "step": np.floor(np.clip(odds, -FAR, FAR) * STEPS).astype(np.int64), "toxic": frame["toxic"].to_numpy(), "times": frame["times"].to_numpy()})

    keys = ["language", "step", "toxic"]
    told = rows.select("text", "toxic", "times").mapInPandas(run, "language long, step long, toxic long, times long").groupBy(*keys).agg(F.sum("times").alias("times")).toPandas().astype("int64").sort_values(keys)
    odds, toxic, groups, times = (told["step"].to_numpy() + 0.5) / STEPS, told["toxic"].to_numpy(), told["language"].to_numpy(), told["times"].to_numpy()
    of_all = threshold(odds, toxic, None, times)
    net.thresholds = np.array([threshold(odds[groups == g], toxic[groups == g], of_all, times[groups == g]) for g in range(len(LANGUAGES))])
    return net


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """The network fitted to all labelled texts that are not held out, with its thresholds. labels: doc_id, toxic."""
    with Workspace(docs.sparkSession) as work:
        rows = work.save(examples(docs, labels), "examples")
        fitted = rows.where("fitted")
        counts = counted(fitted)
        net = started(counts)
        if counts[TABLE].all():
            net = averaged(fitted, net, counts[TABLE], max(1, -(-fitted.count() // SHARD)))
        return calibrated(rows.where("NOT fitted"), net)


class Scorer:
    """Scores texts by a network. What a word adds to the filters is kept for up to CACHE words;
    texts are laid out one behind the other with gaps, at most PIECE words of a text at once."""

    def __init__(self, net: Network) -> None:
        self.net, self.known = net, {}
        self.gap = max(len(f) for f in net.filters) - 1
        #: Row 0 is the gap, which adds nothing; languages as in LANGUAGES.
        self.shares = np.zeros((1, sum(f.shape[0] * f.shape[2] for f in net.filters)), np.float32)
        self.language = np.full(1, len(FUNCTION_WORDS))

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, words
        if not new:
            return
        first = len(self.known) + 1
        self.known.update(zip(new, range(first, first + len(new))))
        if len(self.known) >= len(self.shares):
            more = 2 * len(self.known) + 1 - len(self.shares)
            self.shares = np.vstack([self.shares, np.zeros((more, self.shares.shape[1]), np.float32)])
            self.language = np.r_[self.language, np.full(more, len(FUNCTION_WORDS))]
        self.shares[first : first + len(new)] = self.net.projected(self.net.embedded(Rows(new)))
        self.language[first : first + len(new)] = [_LANGUAGE_OF.get(w, len(FUNCTION_WORDS)) for w in new]

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds and guessed language of each text."""
        self.learn({w for t in texts for w in t})
        coded = [np.fromiter(map(self.known.__getitem__, t), np.int64, len(t)) for t in texts]
        told = np.array([np.bincount(self.language[c], minlength=len(LANGUAGES))[:-1] for c in coded]).reshape(-1, len(FUNCTION_WORDS))
        tops = np.full((len(texts), sum(f.shape[2] for f in self.net.filters)), -np.inf, np.float32)
        pieces = [(i, at, at + PIECE) for i, c in enumerate(coded) for at in range(0, len(c), PIECE)]
        held: list[tuple[int, int, int]] = []
        for k, (i, a, b) in enumerate(pieces):
            held.append((i, a, b))
            if k + 1 == len(pieces) or sum(min(b2, len(coded[i2])) - a2 for i2, a2, b2 in held) >= PIECE:
                self._raise(tops, coded, held)
                held = []
        full = tops[:, 0] > -np.inf if tops.shape[1] else np.zeros(len(texts), bool)
        odds = np.full(len(texts), self.net.base)
        for j, w in enumerate(self.net.out):  # in this order in every batch, so equal texts get equal scores
            odds[full] += np.maximum(tops[full, j], 0) * w
        return odds, np.where(told.any(1), told.argmax(1), len(FUNCTION_WORDS))

    def _raise(self, tops: np.ndarray, coded: list[np.ndarray], held: list[tuple[int, int, int]]) -> None:
        """Raises tops to the values of the filters at the places a to b of each text held."""
        none, row, size = np.zeros(self.gap, np.int64), [], self.gap
        begin, end = [], []
        for i, a, b in held:
            part = coded[i][a : b + self.gap]
            begin.append((size, a == 0))
            end.append(size + min(b, len(coded[i])) - a)
            row += [none, part]
            size += len(part) + self.gap
        rows = np.concatenate([*row, none])
        at = k = 0
        for f, offset in zip(self.net.filters, self.net.offsets):
            width, n = len(f), f.shape[2]
            places = len(rows) - width + 1
            values = np.tile(offset.astype(np.float32), (places, 1))
            for j in range(width):
                values += self.shares[rows[j : j + places], at : at + n]
                at += n
            # Places ahead of a text belong to it as long as its first word is within reach.
            ranges = np.array([[s - (width - 1 if first else 0), e] for (s, first), e in zip(begin, end)]).ravel()
            found = np.maximum.reduceat(np.vstack([values, np.full((1, n), -np.inf, np.float32)]), ranges)[::2]
            np.maximum.at(tops[:, k : k + n], [i for i, _, _ in held], found)
            k += n


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, language (guessed), log_odds, score, predicted of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = sent.value
        scorer = Scorer(net)
        for whole in frames:
            for at in range(0, len(whole), ROWS):
                frame = whole.iloc[at : at + ROWS]
                odds, lang = scorer.scores(_words(frame["text"]))
                p = 1 / (1 + np.exp(-np.clip(odds - net.thresholds[lang], -30, 30)))
                yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "language": [LANGUAGES[g] for g in lang], "log_odds": odds, "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, language string, log_odds double, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, language of every document."""
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted", "language")
