"""Personal data: high-recall span candidates, judged by boosted trees.

Generators propose spans, which may overlap: the base patterns of four kinds, looser forms of
them (numbers with other separators or without a plus sign, addresses with a spelled-out at
sign or dot), and secrets (values given to a name such as token or password, and long runs of
mixed letters and digits). Base matches always stay. The other spans are scored by boosted
trees over the form of the span and its surroundings.

The trees are fitted on rows made from at most SAMPLE_DOCS distinct texts of the same corpus.
Right ones are base matches and secrets that a name is given to, and these rewritten into the
looser forms (loosened); wrong ones are the same spans with their format broken (broken): digits
shuffled until the check digit fails, too few or too many digits, dates, parts out of range,
domains of digits, words of the text joined to a name. What the looser generators find elsewhere
in the corpus is not labelled and so takes no part. The sample is stratified: of the texts with
spans of a kind the first by hash, so a rare kind is met at any corpus size; of their rows too
the first by hash of each kind and label. All forms of one span are in one fold, so held-out
scores are those of spans never seen. Each kind has the lowest threshold at which held-out forms
reach PRECISION. A threshold t starts with PRIOR_ROWS rows of precision t, as calibrated scores
claim: without evidence of a kind its threshold is PRECISION itself, and evidence moves it by
degrees. It is above 1 only where the evidence says that no score is precise enough. Accepted
spans that overlap a base span or a better span are dropped.

Positions count code points, ends are exclusive. Defined results: a null text counts as
empty and has no spans; texts are searched whole, in linear time; repeated rows are judged
alike; an empty table gives an empty result; extra columns are carried along by redact().
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, calibrated
from .common import lean, materialize

#: Kinds in the order that breaks ties of spans with one start.
KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
#: Texts that the trees are fitted on, at most (chosen by hash), and candidates of them.
SAMPLE_DOCS = 20_000
SAMPLE_SPANS = 50_000
#: Texts whose spans are described at once.
ROWS = 256
#: Share of held-out accepted candidates that must be right, by kind.
PRECISION = 0.98
#: Rows that a threshold's own claim counts for beside the held-out rows.
PRIOR_ROWS = 20

Span = tuple[int, int, int]  # start, place in KINDS, end

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive forms: where a run of digits fails as a whole, no later start in it can match.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Looser forms.
_NUMBER = re.compile(r"(?<![0-9])[(]?[0-9](?:[ ()./-]{0,3}[0-9]){6,18}(?![0-9])")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| ?[\[({]dot[\])}] ?)[0-9]{1,3}){3}(?!\.?[0-9])", re.I)
_DOT = r" ?(?:\.|\[\.\]|\(dot\)|\[dot\]|\{dot\}) ?"
_SPELLED = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}} ?(?:\(at\)|\[at\]|\{{at\}}) ?[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", re.I)
_SPELLED_AT = re.compile(r"[(\[{]at[)\]}]", re.I)
_NAME = r"(?:api[_-]?key|secret|token|pass(?:word|wd)|pwd|access[_-]?key|private[_-]?key)"
_GIVEN = re.compile(rf"{_NAME}[\"']?[ ]{{0,3}}(?:=|:)[ ]{{0,3}}[\"']?([^\s\"'<>,;]{{6,256}})", re.I)
_NAMED = re.compile(rf"{_NAME}[\"']?[ ]{{0,3}}(?:=|:)?[ ]{{0,3}}[\"']?$", re.I)
_MIXED = re.compile(r"(?<![A-Za-z0-9_+/=.@-])[A-Za-z0-9_+/=-]{16,256}(?![A-Za-z0-9_+/=@-])")
_CONTEXT = {
    "email": re.compile(r"mail|contact|write", re.I), "ip": re.compile(r"\bip\b|host|address|server|login", re.I),
    "card": re.compile(r"card|visa|credit|account|pay", re.I), "phone": re.compile(r"phone|tel\b|call|mobile|fax|cell", re.I), "secret": re.compile(_NAME, re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The matches of the base patterns, leftmost and not overlapping within a kind."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 12 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str) -> list[Span]:
    """Spans of looser form, of every kind that they could be; they may overlap."""
    found: set[Span] = set()
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            found.add((m.start(), 3, m.end()))
            if sum(c.isdigit() for c in m[0]) >= 12:
                found.add((m.start(), 2, m.end()))
        found.update((m.start(), 1, m.end()) for m in _DOTTED.finditer(text))
        found.update((m.start(), SECRET, m.end()) for m in _MIXED.finditer(text) if _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0]))
    if _SPELLED_AT.search(text):
        found.update((m.start(), 0, m.end()) for m in _SPELLED.finditer(text))
    found.update((m.start(1), SECRET, m.end(1)) for m in given(text))
    return sorted(found)


def describe(text: str, span: Span) -> list[float]:
    """Features of a span: its form, the characters around it and the words before it."""
    start, kind, end = span
    body, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 10]
    digits = re.sub("[^0-9]", "", body)
    groups = [len(g) for g in re.findall("[0-9]+", body)]
    side = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0
    parts = [int(g) for g in re.findall("[0-9]{1,9}", body)]
    domain = re.split(r"@|[(\[{]at[)\]}]", body, maxsplit=1, flags=re.I)[-1] if kind == 0 else ""
    counts = Counter(body)
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        float(len(body)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)), float(groups[0] if groups else 0), float(groups[-1] if groups else 0),
        float(len(set(digits))), float(luhn(digits)) if kind == 2 else 0.0, float(digits[:1] or 0), float(max(parts, default=0)) if kind == 1 else 0.0, float(min(parts[0], 3000)) if kind == 3 and parts else 0.0,
        float(body.count("(")), float(body.count("-")), float(body.count(" ")), float(body.count(".")), float(body.count("/")),
        float(sum(c.isalpha() for c in domain)), float(sum(c.isalpha() for c in re.split(r"[. \])}]+", domain)[-1])),
        sum(c.isalpha() for c in body) / len(body), sum(c.isupper() for c in body) / len(body), -sum(n / len(body) * math.log2(n / len(body)) for n in counts.values()),
        sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(body, body[1:])) / len(body), float(sum(c in "_-/" for c in body)), float(bool(_NAMED.search(before))),
        side(before[-1:]), side(after[:1]), float(before.rstrip().endswith("+")), float(bool(_CONTEXT[KINDS[kind]].search(before))),
        sum(c.isdigit() for c in before) / 40, sum(c.isdigit() for c in after) / 10,
    ]


def _grouped(digits: str, sizes: tuple[int, ...], mark: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return mark.join(x for x in [*out, digits[at:]] if x)


def _within(text: str, span: Span, forms: list[str], lead: str = "") -> list[tuple[str, Span]]:
    """The text around a span with the span in other forms, each after lead."""
    start, kind, end = span
    head, tail = text[max(0, start - 40) : start] + lead, text[end : end + 10]
    return [(head + f + tail, (len(head), kind, len(head) + len(f))) for f in forms if f]


def loosened(text: str, span: Span) -> list[tuple[str, Span]]:
    """A right span in looser forms."""
    body, kind = text[span[0] : span[2]], span[1]
    digits, bare = re.sub("[^0-9]", "", body), body.lstrip("+")
    if kind == 0:
        return _within(text, span, [body.replace("@", "(at)"), body.replace("@", " [at] ").replace(".", " [dot] "), body.replace("@", "[at]").replace(".", "[.]"), body.replace("@", " (at) ")])
    if kind == 1:
        return _within(text, span, [body.replace(".", "[.]"), body.replace(".", "(.)"), body.replace(".", " [dot] ")])
    if kind == 2:
        return _within(text, span, [_grouped(digits, (4, 4, 4), m) for m in "./"] + [_grouped(digits, (4, 6), "."), _grouped(digits, (4, 4, 4), " - ")])
    if kind == 3:
        ten = digits[-10:]
        forms = [bare, bare.replace(" ", "-"), bare.replace(" ", "/"), bare.replace(" ", "."), f"({ten[:3]}) {ten[3:6]}-{ten[6:]}", _grouped(ten, (3, 3), "-"), _grouped(digits, (2, 3, 3), " "), _grouped("0" + ten, (4, 3), " ")]
        return _within(text, span, forms) + _within(text, span, [digits, ten], "phone ")
    return _within(text, span, [body[: len(body) * 3 // 4], body[::-1], body[:12], body[-9:]]) + _within(text, span, [body], "secret: ")


def broken(text: str, span: Span) -> list[tuple[str, Span]]:
    """The same places with spans of no kind: each breaks the format of the span's own."""
    body, kind = text[span[0] : span[2]], span[1]
    digits, dice = re.sub("[^0-9]", "", body), random.Random(xxhash.xxh3_64_intdigest(body))
    number = lambda n: str(dice.randrange(1, 10)) + "".join(str(dice.randrange(10)) for _ in range(n - 1))
    date = (dice.randrange(1900, 2100), dice.randrange(1, 13), dice.randrange(1, 29))
    if kind == 0:
        return _within(text, span, [f"{number(2)}(at){number(2)}.{number(1)}", f"{number(3)} [at] {number(3)} [dot] {number(2)}", f"x(at){number(4)}.{number(3)}", f"{number(1)}(at)x.{number(1)}"])
    if kind == 1:
        parts, at = body.split("."), dice.randrange(4)
        parts[at] = str(dice.randrange(256, 1000))
        return _within(text, span, [".".join(parts), "[.]".join(parts), " [dot] ".join(parts)])
    if kind == 2:
        wrong = list(digits)
        for _ in range(40):
            dice.shuffle(wrong)
            if not luhn("".join(wrong)):
                break
        wrong = "".join(wrong) if not luhn("".join(wrong)) else digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return _within(text, span, [wrong, *(_grouped(wrong, (4, 4, 4), m) for m in "./- "), _grouped(wrong, (3, 3, 3, 3), ".")])
    if kind == 3:
        short, long = number(dice.randrange(7, 9)), number(dice.randrange(16, 19))
        forms = [short, _grouped(short, (3,), "-"), _grouped(short, (4,), "-"), _grouped(short, (2, 3), " "), long, _grouped(long, (4, 4, 4), "."), _grouped(long, (4, 4, 4), " "), digits, number(dice.randrange(9, 15)), f"{number(1)}.{number(8)}"]
        year, month, day = date
        forms += [f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{day:02}/{month:02}/{year}", f"{year}/{month:02}/{day:02} {dice.randrange(24):02}", f"{year}-{year + 1}"]
        plain = re.sub(r"\S*(?:phone|tel|call|mobile|fax|cell)\S*", "", text[max(0, span[0] - 40) : span[0]], flags=re.I)
        return _within(plain + text[span[0] :], (len(plain), 3, len(plain) + len(body)), forms)
    words = re.findall("[A-Za-z]{2,12}", text[max(0, span[0] - 80) : span[0]])[-4:] or ["part", "one"]
    named = _within(text, span, ["".join(words)[:14].ljust(6, "e"), words[0].ljust(6, "a")])
    return named + [x for m in "_-/" for x in _within(re.sub(rf"(?i){_NAME}", "", text[max(0, span[0] - 40) : span[0]]).rstrip("\"'=: ") + " ", (10**6, SECRET, 10**6), [m.join([*words, number(2)]), number(4) + m + m.join(words)])]


@dataclass
class Model:
    trees: Trees
    #: Least score of each kind; above 1 where the evidence is that no threshold is precise enough.
    thresholds: np.ndarray


def given(text: str) -> list[re.Match]:
    """Values that a secret's name is given; the marks between them are looked for first, as
    few texts have any."""
    return list(_GIVEN.finditer(text)) if "=" in text or ":" in text else []


def sure_spans(text: str) -> list[Span]:
    """Base matches, and secrets that a name is given to: mixed values of 16 or more characters."""
    secrets = [(m.start(1), SECRET, m.end(1)) for m in given(text) if len(m[1]) >= 16 and _DIGIT.search(m[1]) and re.search("[A-Za-z]", m[1])]
    return base_spans(text) + secrets


def strata(text: str) -> int:
    """Bits: k where text has right spans of kind k."""
    return sum({1 << s[1] for s in sure_spans(text)})


def fitting_rows(text: str) -> list[tuple[int, int, bool, int, list[float]]]:
    """Kind, label, whether the form is a looser one, fold, and features, of what a text is fitted on."""
    rows = []
    for span in sure_spans(text):
        fold = xxhash.xxh3_64_intdigest(text[span[0] : span[2]]) % 3
        rows.append((span[1], 1, span[1] == SECRET, fold, describe(text, span)))
        rows += [(span[1], 1, True, fold, describe(t, s)) for t, s in loosened(text, span)]
        rows += [(span[1], 0, True, fold, describe(t, s)) for t, s in broken(text, span)]
    return rows


def sample(docs: DataFrame, sample_docs: int) -> DataFrame:
    """h (hash) and text of the distinct texts of each stratum that come first by hash."""
    hashed = docs.select(F.xxhash64("text").alias("h"), "text").where(F.col("text").rlike("[0-9@]"))  # right spans have one of these

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = pd.DataFrame({"h": frame["h"], "kinds": [strata(t) for t in frame["text"]]})
            yield frame[frame["kinds"] > 0]

    found = materialize(hashed.mapInPandas(lean(run), "h long, kinds int").distinct(), "pii-strata")
    each, taken = max(1, sample_docs // len(KINDS)), F.lit(False)
    for bit in range(len(KINDS)):
        own = F.col("kinds").bitwiseAND(1 << bit) != 0
        last = found.where(own).orderBy("h").limit(each).agg(F.max("h")).first()[0]
        taken = taken if last is None else taken | (own & (F.col("h") <= last))
    few = found.where(taken).select("h")
    return hashed.join(F.broadcast(few), "h", "left_semi").distinct()


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Trees from a bounded sample of docs; without any right spans, a model that adds nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (f.iloc[at : at + ROWS] for f in frames for at in range(0, len(f), ROWS)):
            rows = [(f"{h} {i}", *r) for h, text in zip(frame["h"], frame["text"]) for i, r in enumerate(fitting_rows(text))]
            yield pd.DataFrame({"r": [xxhash.xxh3_64_intdigest(r[0]) - 2**63 for r in rows], "k": [r[1] for r in rows], "y": [float(r[2]) for r in rows], "loose": [r[3] for r in rows], "fold": [r[4] for r in rows], "x": [r[5] for r in rows]})

    full = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    every = materialize(sample(full, sample_docs).mapInPandas(lean(run), "r long, k int, y double, loose boolean, fold int, x array<double>"), "pii-rows")
    each = SAMPLE_SPANS // (2 * len(KINDS))
    parts = [every.where((F.col("k") == k) & (F.col("y") == y)).orderBy("r", "x").limit(each) for k in range(len(KINDS)) for y in (0.0, 1.0)]
    rows = reduce(DataFrame.unionAll, parts).toPandas()
    if not len(rows):
        return Model(Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 0.0), np.full(len(KINDS), 2.0))
    x, y, loose, fold = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(), rows["loose"].to_numpy(bool), rows["fold"].to_numpy()
    order = np.lexsort((fold, loose, y, *x.T))
    x, y, loose, fold = x[order], y[order], loose[order], fold[order]
    trees, held = calibrated(x, y, fold, rounds=60)
    return Model(trees, np.array([threshold(held[own], y[own]) for own in (loose & (x[:, k] == 1) for k in range(len(KINDS)))]))


def threshold(held: np.ndarray, y: np.ndarray) -> float:
    """The lowest score from which on PRECISION holds for a kind's held-out looser forms."""
    found = 2.0
    for t in np.linspace(0.99, 0.5, 50):
        told = held >= t
        if (y[told].sum() + PRIOR_ROWS * t) / (told.sum() + PRIOR_ROWS) >= PRECISION - 1e-9:
            found = t
    return found


def select(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans."""
    return [pair for at in range(0, len(texts), ROWS) for pair in _select(texts[at : at + ROWS], model)]


def _select(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    out, asked, owner = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, base))
        ends = sorted((a, b) for a, _, b in base)
        starts = np.array([a for a, _ in ends])
        furthest = np.maximum.accumulate([b for _, b in ends]) if ends else starts
        for s in candidates(text):
            k = int(np.searchsorted(starts, s[2])) if ends else 0  # base spans that start before its end
            if not k or furthest[k - 1] <= s[0]:
                asked.append(describe(text, s))
                owner.append((i, s))
    if asked:
        scores, taken = model.trees.predict(np.array(asked)), {}
        for j in np.argsort(-scores, kind="stable"):
            i, s = owner[j]
            if scores[j] >= model.thresholds[s[1]] and all(s[2] <= a or b <= s[0] for a, _, b in taken.get(i, [])):
                taken.setdefault(i, []).append(s)
        for i, more in taken.items():
            out[i] = (out[i][0], sorted([*out[i][0], *more]))
    return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts by kind and the digest of base spans, all spans, and how many of these are
    secrets (n_secret) and in all (n_spans), of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = select(frame["text"].tolist(), sent.value)
            counts = {f"n_{k}": [sum(s[1] == i for s in base) for base, _ in pairs] for i, k in enumerate(KINDS[:SECRET])}
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), **counts, "base_sha256": [hashlib.sha256(told(base).encode()).hexdigest() for base, _ in pairs], "spans": [told(every) for _, every in pairs], "n_secret": [sum(s[1] == SECRET for s in every) for _, every in pairs], "n_spans": [len(every) for _, every in pairs]})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long")


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind; overlapping spans become one, of the first's kind."""
    parts, at, until = [], 0, 0
    for a, k, b in spans:
        if a >= until:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = until = max(until, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every span in text replaced; null texts and all other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            full = ["" if t is None else t for t in texts]
            yield pd.Series([None if t is None else redacted(t, every) for t, (_, every) in zip(texts, select(full, sent.value))], dtype=object)

    return docs.withColumn("text", F.pandas_udf(lean(clean), "string")("text")).select(*docs.columns)
