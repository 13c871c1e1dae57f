import math
import re
import unicodedata
from collections import defaultdict

from threadloom.llm import quality_rules as q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def digest(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_corpus(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in q.quality_verdicts(docs).collect()}
    assert {i: digest(r) for i, r in got.items()} == {i: brute(t) for i, t in texts.items()}
    assert all(not (r.base_failed and r.kept) for r in got.values())
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    clean = [i for i, v in quality.items() if v == 1 and not got[i].base_failed]
    assert sum(got[i].kept for i in clean) >= 0.97 * len(clean)
    junk = [i for i, v in quality.items() if v == 0]
    assert sum(not got[i].kept for i in junk) >= 0.9 * len(junk)
    kept = q.filter_quality(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_edges(spark):
    odd = ["", None, " \n\t", "a b c d e " * 3, "x\x0by\x0cz\r\nx", "one\n\none\n \none", "w " * 60_000, "é ñ # $ %"]
    rows = [(i, t, "en", "s", 5) for i, t in enumerate(odd)] + [(None, "a", None, None, None), (0, "", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = q.quality_verdicts(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: digest(r) for r in got if r.doc_id is not None} == {i: brute(t) for i, t in enumerate(odd)}
    assert q.filter_quality(docs).columns == docs.columns
    assert q.quality_verdicts(docs.limit(0)).count() == 0


def test_sketches_merge(spark):
    rows = spark.range(1, 20_001).selectExpr("id % 2 AS g", "double(id) AS x")
    fine = q.sketch(rows, ["g"], {"x": "x"})
    both = q.quantiles(q.merge(fine, []), [], {"q25": 0.25, "q75": 0.75}).first()
    assert abs(both.q25 / 5_000 - 1) < 0.011 and abs(both.q75 / 15_000 - 1) < 0.011 and both.total == 20_000


def expected_kept(rows):
    """kept by doc_id, from (doc_id, lang, source, statistics) in plain Python."""
    parts = [("symbols", "words", 1), ("upper", "chars", 1), ("dup", "lines", 1), ("repeat", "words", 10), ("chars", "words", 0)]
    value = lambda s, a, b: s[a] / max(s[b], 1)
    names = {f"{a}/{b}": (lambda s, a=a, b=b: value(s, a, b)) for a, b, _ in parts} | {b: (lambda s, b=b: float(s[b])) for b in ("words", "chars", "lines")}

    def quantile(values, share):
        buckets = sorted(-math.inf if x < 1e-4 else math.ceil(math.log(x) / math.log(1.02)) for x in values)
        at = buckets[math.ceil(share * len(buckets)) - 1]
        return 0.0 if at == -math.inf else 1.02 ** (at - 0.5)

    levels = [defaultdict(list) for _ in range(3)]
    for _, lang, source, s in rows:
        for level, key in zip(levels, ((lang, source), lang, None)):
            level[key].append(s)
    known = {}

    def drawn(lang, source, name, share):
        key = (lang, source, name, share)
        if key not in known:
            out = None
            for level, k in zip(reversed(levels), (None, lang, (lang, source))):
                own = quantile([names[name](s) for s in level[k]], share)
                out = own if out is None else (len(level[k]) * own + 200 * out) / (len(level[k]) + 200)
            known[key] = out
        return known[key]

    kept = {}
    for i, lang, source, s in rows:
        ok = not s["failed"]
        for a, b, unit in parts:
            name = f"{a}/{b}"
            q = {p: drawn(lang, source, name, p / 100) for p in (10, 25, 50, 75, 90)}
            step = unit / min(max(s[b], 1), max(drawn(lang, source, b, 0.5), 1)) if unit else 0.5 * q[50] / math.sqrt(max(s[b], 1))
            ok &= value(s, a, b) <= q[75] + 3 * max(q[75] - q[25], q[90] - q[75]) + 3 * step
            if not unit:
                ok &= value(s, a, b) >= q[25] - 3 * max(q[75] - q[25], q[25] - q[10]) - 3 * step
        kept[i] = ok
    return kept


def test_kept_is_as_in_plain_python(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = []
    for r in docs.collect():
        n, chars, symbols, dup, repeat, failed = brute(r.text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (r.text or "").split("\n"))
        rows.append((r.doc_id, r.lang, r.source, {"words": n, "chars": chars, "symbols": symbols, "dup": dup, "repeat": repeat, "failed": failed, "lines": lines, "upper": sum(unicodedata.category(c) == "Lu" for c in r.text or "")}))
    want = expected_kept(rows)
    got = {r.doc_id: r.kept for r in q.quality_verdicts(docs).collect()}
    assert got == want
    assert 0 < sum(got.values()) < len(got)


def test_limits_follow_the_group(spark):
    """A source that writes in capitals keeps its documents; one such document elsewhere goes."""

    def text(i, up):
        words = " ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}{'xyz'[j // 26]}rd" for j in range(40))
        return words.upper() if up else words

    rows = [(i, text(i, False), "en", "low") for i in range(1500)] + [(2000 + i, text(i, True), "en", "loud") for i in range(1500)] + [(5000, text(7, True), "en", "low")]
    got = {r.doc_id: r.kept for r in q.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in got if i != 5000) and not got[5000]
