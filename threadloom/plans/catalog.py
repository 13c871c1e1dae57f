"""Named queries over the driver's tables, each with the same result as SQL for DuckDB.

sql=None marks what SQL cannot say (stemming, JSON documents, streams)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import index as I
from ..operators import matching as Q
from ..operators import merging as M
from ..operators import recall as R
from ..operators import search as S
from ..operators import sessions as O
from ..operators import substrings as G
from ..operators import topics as T
from ..operators import vectors as V
from ..sources.shared import shared_path, written
from . import fixtures as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = 1.8e9


def query(sql: str | None = None, base: bool = True):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{D.base_sql()}\n{sql}" if base else sql
        return f

    return add


def text_query(name: str, column: Callable, sql: str) -> None:
    """A query of id and one computed column of the decorated messages."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.messages(spark, sf_dir, True).select("id", column().alias("value"))

    run.__name__ = name
    query(f"SELECT id, {sql} AS value FROM deco")(run)


C = lambda: F.col("content")
GEN = D.generated_sql("content")
text_query("strip_tools", lambda: X.strip_tools(C()), D.clean_sql(D.tools_sql("content")))
text_query("strip_envelopes", lambda: X.strip_envelopes(C()), D.envelopes_sql("content"))
text_query("strip_thinking", lambda: X.strip_thinking(C()), D.thinking_sql("content"))
text_query("strip_generated", lambda: X.strip_generated(C()), GEN)
text_query("display_text", lambda: X.display_text(C(), thinking=False, cap=60), f"left({D.generated_sql(D.thinking_runs_sql('content'))}, 60)")
text_query("display_all", lambda: X.display_text(C(), tools=True), D.clean_sql("content"))
text_query("display_tools", lambda: X.display_text(C(), tools=True, thinking=False), D.thinking_sql("content"))
text_query("is_low_signal", lambda: X.is_low_signal(C()), D.low_signal_sql("content"))
text_query("is_displayable", lambda: X.is_displayable(C()), D.displayable_sql("content"))
text_query("is_human_turn", lambda: X.is_human_turn(F.col("role"), C()), D.human_sql("role", "content"))
text_query("msg_role", lambda: X.non_empty(F.when(F.col("id") % 3 == 0, "").otherwise(F.col("role")), F.lit("user")), "coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE role END, ''), 'user')")
text_query("msg_uuid", lambda: X.non_empty(F.when(F.col("id") % 4 == 0, "").otherwise(F.col("uuid")), F.when(F.col("id") % 8 == 0, F.col("session_id"))), "coalesce(nullif(CASE WHEN id % 4 = 0 THEN '' ELSE uuid END, ''), CASE WHEN id % 8 = 0 THEN session_id END, '')")
text_query("mint_uuid", lambda: X.mint_uuid(F.col("session_id"), F.col("id").cast("string")), "left(sha1(session_id || ':' || id), 16)")
text_query("normalize_uuid", lambda: X.normalize_uuid(F.when(F.col("id") % 2 == 0, F.upper("uuid")).otherwise("x-1"), F.col("session_id"), F.col("id").cast("string")), "CASE WHEN id % 2 = 0 THEN uuid ELSE left(sha1(session_id || ':' || id), 16) END")
text_query("normalize_role", lambda: X.normalize_role(F.element_at(F.array(*map(F.lit, ["Human ", "MODEL", "bot", "tool", "system", "user", "other"])), (F.col("id") % 7 + 1).cast("int"))), "CASE id % 7 WHEN 0 THEN 'user' WHEN 4 THEN 'system' WHEN 5 THEN 'user' ELSE 'assistant' END")
text_query("normalize_epoch", lambda: F.round(X.normalize_epoch(F.when(F.col("id") % 4 == 0, (F.col("ts") * 1e6).cast("long").cast("string")).when(F.col("id") % 4 == 1, (F.col("ts") * 1e3).cast("long").cast("string")).when(F.col("id") % 4 == 2, F.col("ts_iso")).otherwise(F.replace(F.rtrim(F.col("ts_iso"), F.lit("Z")), F.lit("T"), F.lit(" ")))), 3), "ts")
text_query("iso_to_epoch", lambda: X.iso_to_epoch(F.when(F.col("id") % 5 == 0, "no time").otherwise(F.col("ts_iso"))), "CASE WHEN id % 5 = 0 THEN 0.0 ELSE ts END")
text_query("content_hash", lambda: X.content_hash(C()), "left(sha1(content), 16)")
text_query("read_ref", lambda: X.read_ref(F.col("session_id"), F.col("uuid")), "left(session_id, 8) || ':' || left(uuid, 8)")
text_query("condense", lambda: X.condense(F.col("uuid"), F.col("role"), C()), f"left(uuid, 8) || ' [' || role || '] ' || left({D.clean_sql('content')}, 200)")
text_query("coverage", lambda: X.coverage(C(), F.array(*map(F.lit, ["the", "trash", "tion"]))).cast("long"), "CAST(contains(lower(content), 'the') AS BIGINT) + CAST(contains(lower(content), 'trash') AS BIGINT) + CAST(contains(lower(content), 'tion') AS BIGINT)")
text_query(
    "make_snippet", lambda: X.make_snippet(C(), F.array(F.lit("tion"))),
    "CASE WHEN contains(lower(content), 'tion') THEN " + D.clean_sql("regexp_replace(substr(content, greatest(instr(lower(content), 'tion') - 90, 1), instr(lower(content), 'tion') + 170 - greatest(instr(lower(content), 'tion') - 90, 1)), '(tion)', '>>>\\1<<<', 'gi')") + " END",
)
text_query("rrf_term", lambda: F.round(X.rrf_term(F.col("id") % 50 + 1), 9), "round(1.0 / (60 + id % 50 + 1), 9)")


@query("SELECT id, regexp_extract(cwd, '([^/]+)/*$', 1) AS project_label FROM sessions")
def project_of(spark, sf):
    return D.sessions(spark, sf).select("id", X.project_of(F.concat("cwd", F.lit("/"))).alias("project_label"))


@query("SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))), 6) AS similarity FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)", base=False)
def cosine(spark, sf):
    e = D.table(spark, sf, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return e.join(F.broadcast(one)).select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query("""SELECT session_id, sha1(string_agg(start_uuid || chr(1) || '' || chr(1) || topic || chr(1) || summary, chr(1) ORDER BY start_uuid)) AS hash
FROM segments WHERE topic <> '' GROUP BY session_id""".replace("chr(1)", "chr(1)"))
def segment_hash(spark, sf):
    s = D.segments(spark, sf).where("topic <> ''")
    rows = s.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("start_uuid", F.lit(None).cast("string").alias("end_uuid"), "topic", "summary"))).alias("s"))
    # Character 1 stands in for the NUL that SQL text cannot hold.
    joined = F.array_join(F.transform("s", lambda x: F.concat_ws("\x01", x["start_uuid"], F.lit(""), x["topic"], x["summary"])), "\x01")
    return rows.select("session_id", F.sha1(joined).alias("hash"))


# Terms and search

STOPS = ", ".join(f"'{w}'" for w in Q.STOPWORDS)
TERMS = f"""terms_0 AS (SELECT query_id, regexp_replace(text, '&&|\\|\\||(^|[^\\w])!', '\\1 ', 'g') AS t FROM queries),
terms AS (SELECT DISTINCT query_id, trim(lower(p), '" ') AS term, true AS is_phrase FROM (SELECT query_id, unnest(regexp_extract_all(t, '"[^"]+"')) AS p FROM terms_0)
 UNION SELECT query_id, w, regexp_matches(w, '\\w[./_-]\\w') FROM (SELECT query_id, lower(unnest(string_split_regex(trim(regexp_replace(regexp_replace(t, '"[^"]*"', ' ', 'g'), '[+(){{}}^"\\s]+', ' ', 'g')), ' '))) AS w FROM terms_0)
 WHERE w NOT IN ('', 'and', 'or', 'not', {STOPS}))"""
#: What the boolean queries of the table ask for, written out: alternative, segment, whether it is excluded, words.
CLAUSES = """clauses(query_id, alt, seg, negative, item) AS (VALUES (3, 0, 0, false, 'stupid'), (3, 0, 1, true, 'clown'), (6, 0, 0, false, 'scum'), (6, 0, 1, false, 'moron'), (7, 0, 0, false, 'disgusting'), (7, 1, 1, false, 'idiot'),
 (9, 0, 1, true, 'trash'), (12, 0, 0, false, 'thou'), (12, 0, 1, false, 'thwh'), (13, 0, 0, false, 'ernt'), (13, 0, 1, true, 'onti'), (14, 0, 0, false, 'erth'), (14, 1, 1, false, 'einst'), (17, 0, 0, false, 'thou'), (17, 1, 1, false, 'thwh'),
 (17, 1, 3, true, 'erin'), (18, 0, 0, false, 'of the'), (18, 0, 2, true, 'trash'), (20, 0, 0, false, 'disgusting'), (20, 0, 1, true, 'clown'), (20, 0, 2, true, 'moron'), (21, 0, 0, false, 'hthnd'), (21, 0, 1, false, 'zzz'))"""


def scored_sql(items: str) -> str:
    """scored: BM25 of items (query_id, item) over messages."""
    return f"""words AS (SELECT id, {D.tokens_sql("content")} AS w FROM messages),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM words),
items AS ({items}),
each_item AS (SELECT DISTINCT item, string_split(item, ' ') AS ws FROM items),
tf AS (SELECT id, len, item, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS item FROM words) WHERE item IN (SELECT item FROM each_item) GROUP BY ALL
 UNION ALL SELECT id, len, item, tf FROM (SELECT id, len(w) AS len, item, len(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(ws) - 1] = ws)) AS tf FROM words, each_item WHERE len(ws) > 1) WHERE tf > 0),
df AS (SELECT item, count(*) AS df FROM tf GROUP BY item),
scored_items AS (SELECT query_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
  FROM tf JOIN df USING (item) JOIN items USING (item) CROSS JOIN corpus WHERE NOT negative GROUP BY query_id, id)"""


ITEMS = f"SELECT DISTINCT query_id, array_to_string({D.tokens_sql('term')}, ' ') AS item, false AS negative FROM terms WHERE len({D.tokens_sql('term')}) > 0"
BM25 = f"{TERMS}, {scored_sql(ITEMS)}, scored AS (SELECT * FROM scored_items)"
MATCH = f"""{TERMS}, {CLAUSES}, {scored_sql(ITEMS + " AND query_id NOT IN (SELECT query_id FROM clauses) UNION SELECT query_id, item, negative FROM clauses")},
met AS (SELECT DISTINCT query_id, id FROM (SELECT c.query_id, c.alt, c.seg, c.negative, d.id, bool_and(tf.id IS NOT NULL) AS has FROM clauses c CROSS JOIN messages d LEFT JOIN tf ON tf.item = c.item AND tf.id = d.id GROUP BY ALL)
 GROUP BY query_id, alt, id HAVING bool_and(has <> negative) AND count(*) FILTER (NOT negative) > 0),
scored AS (SELECT * FROM scored_items s WHERE query_id NOT IN (SELECT query_id FROM clauses) OR EXISTS (SELECT 1 FROM met WHERE met.query_id = s.query_id AND met.id = s.id))"""
FALLBACK = f"""{MATCH}, fallback AS (SELECT query_id, id, 0.0 AS score FROM messages, (SELECT query_id, lower(trim(text)) AS probe FROM queries WHERE query_id NOT IN (SELECT query_id FROM scored) AND query_id NOT IN (SELECT query_id FROM clauses)) q WHERE length(probe) >= 3 AND contains(lower(content), probe))"""


def keyword_sql(order: str = "h.score DESC, h.id", final: str = "coverage DESC, bm25_rank") -> str:
    return f"""{FALLBACK}, hits AS (SELECT *, true AS by_word FROM scored UNION ALL SELECT *, false FROM fallback),
ranked AS (SELECT h.query_id, h.id, m.session_id, m.uuid, m.content, h.score, h.by_word, row_number() OVER (PARTITION BY h.query_id ORDER BY {order}) AS bm25_rank
  FROM hits h JOIN messages m USING (id) JOIN sessions s ON m.session_id = s.id AND NOT s.is_subagent),
shown_terms AS (SELECT query_id, term FROM terms WHERE query_id NOT IN (SELECT query_id FROM clauses) UNION SELECT query_id, item FROM clauses),
fetched AS (SELECT q.query_id, CASE WHEN q.query_id NOT IN (SELECT query_id FROM clauses) AND count(DISTINCT term) > 1 THEN 64 ELSE 32 END AS most FROM queries q LEFT JOIN shown_terms t USING (query_id) GROUP BY q.query_id),
covered AS (SELECT r.query_id, r.id, r.session_id, r.uuid, r.score, r.bm25_rank, CASE WHEN by_word THEN (SELECT count(DISTINCT term) FROM shown_terms t WHERE t.query_id = r.query_id AND contains(lower({GEN.replace("content", "r.content")}), t.term))
  ELSE 1 END AS n_found FROM ranked r JOIN fetched f USING (query_id) WHERE bm25_rank <= most AND {D.displayable_sql("content")}),
keyword AS (SELECT query_id, id, session_id, uuid, score, bm25_rank, coverage, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {final}) AS rank FROM
  (SELECT *, CASE WHEN query_id IN (SELECT query_id FROM clauses) THEN least(n_found, 1) ELSE n_found END AS coverage FROM covered) WHERE coverage > 0) WHERE rank <= 8)"""


KEYWORD = keyword_sql()


_indexes: dict[tuple[str, str], str] = {}


def word_index(spark, sf, stem=None) -> I.WordIndex:
    """The stored index of the messages, of words or stems, written once a session and folder."""
    key = (spark.sparkContext.applicationId, f"{sf}#{stem}")
    if key not in _indexes:
        path = shared_path(spark, "word-index")
        I.write_index(D.messages(spark, sf), path, stem=stem)
        _indexes[key] = path
    return I.open_index(spark, _indexes[key])


def gram_index(spark, sf) -> G.GramIndex:
    """The stored trigrams of the messages, written once a session and folder."""
    key = (spark.sparkContext.applicationId, f"{sf}#grams")
    if key not in _indexes:
        path = shared_path(spark, "gram-index")
        G.write_gram_index(D.messages(spark, sf), path)
        _indexes[key] = path
    return G.open_gram_index(spark, _indexes[key])


def terms(spark):
    return S.query_terms(D.queries(spark))


def keyword(spark, sf, sort="relevance"):
    return S.keyword_search(D.messages(spark, sf), D.sessions(spark, sf), D.queries(spark), sort=sort, index=word_index(spark, sf)).withColumns({c: F.col(c).cast("long") for c in ("coverage", "rank", "bm25_rank")})


@query(f", {D.ASKED}, {TERMS.replace('FROM queries', 'FROM asked')} SELECT query_id, term, is_phrase FROM terms")
def query_terms(spark, sf):
    """Terms of queries made of the first words of every message."""
    return S.query_terms(D.asked(spark, sf)).select("query_id", "term", "is_phrase").distinct()


@query(f"SELECT term, CAST(count(*) AS BIGINT) AS df FROM (SELECT DISTINCT id, unnest({D.tokens_sql('content')}) AS term FROM messages) GROUP BY term")
def term_stats(spark, sf):
    return S.term_stats(D.messages(spark, sf))


@query(f"SELECT id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS term FROM (SELECT id, {D.tokens_sql('content')} AS w FROM messages)")
def tokenize(spark, sf):
    return S.tokenize(D.messages(spark, sf))


PORTER = f", spoken AS (SELECT id, {D.tokens_sql('content')} AS w FROM messages), {D.porter_sql('SELECT DISTINCT unnest(w) AS word FROM spoken')}"


@query(f"{PORTER} SELECT id, pos, coalesce(stem, t.word) AS term FROM (SELECT id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS word FROM spoken) t LEFT JOIN stems USING (word)")
def tokenize_porter(spark, sf):
    return S.tokenize(D.messages(spark, sf), "porter")


@query(f", {BM25} SELECT query_id, id, score FROM scored")
def bm25(spark, sf):
    return S.bm25(word_index(spark, sf), terms(spark))


@query(f", w AS (SELECT id, unnest({D.tokens_sql('content')}) AS term, len({D.tokens_sql('content')}) AS len FROM messages) SELECT term, id, CAST(len AS INTEGER) AS len, CAST(count(*) AS INTEGER) AS tf, CAST(count(*) OVER (PARTITION BY term) AS BIGINT) AS df FROM w GROUP BY term, id, len")
def build_index(spark, sf):
    """What the stored index holds of every term and message."""
    index = word_index(spark, sf)
    return index.postings.join(index.terms, ["bucket", "term"]).select("term", "id", "len", "tf", "df")


@query(f", w AS (SELECT id, unnest({D.tokens_sql('content')}) AS term, generate_subscripts({D.tokens_sql('content')}, 1) - 1 AS pos FROM messages) SELECT term, id, array_to_string(list_sort(list(pos)), ',') AS positions FROM w GROUP BY term, id")
def index_positions(spark, sf):
    return word_index(spark, sf).postings.select("term", "id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f", {BM25.replace('FROM messages', 'FROM (SELECT doc_id AS id, text AS content FROM documents)')} SELECT query_id, id, score FROM scored")
def bm25_documents(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return S.bm25(docs, terms(spark))


@query(f", now AS (SELECT id, CASE WHEN id % 10 = 3 THEN 'fresh ' || content ELSE content END AS content FROM messages WHERE id % 10 <> 7), w AS (SELECT id, unnest({D.tokens_sql('content')}) AS term, len({D.tokens_sql('content')}) AS len FROM now) SELECT term, id, CAST(len AS INTEGER) AS len, CAST(count(*) AS INTEGER) AS tf, CAST(count(*) OVER (PARTITION BY term) AS BIGINT) AS df, (SELECT count(*) FROM now) AS n_docs FROM w GROUP BY term, id, len")
def update_index(spark, sf):
    """An index of which a tenth of the messages was replaced and a tenth removed afterwards."""
    m, path = D.messages(spark, sf), shared_path(spark, "updated-index")
    I.write_index(m, path)
    changed = m.where("id % 10 = 3").withColumn("content", F.concat(F.lit("fresh "), "content"))
    index = I.update_index(spark, path, changed, m.where("id % 10 = 7").select("id"))
    rows = index.postings.join(index.terms, ["bucket", "term"]).join(F.broadcast(index.totals))  # totals: one row
    return rows.select("term", "id", "len", "tf", "df", "n_docs")


@query(f"SELECT p.query_id, w.id, p.term FROM (SELECT id, ' ' || array_to_string({D.tokens_sql('content')}, ' ') || ' ' AS t FROM messages) w, (VALUES (1, 'of the'), (2, 'the and'), (3, 'scum')) p(query_id, term) WHERE contains(w.t, ' ' || p.term || ' ')")
def phrase_search(spark, sf):
    phrases = spark.createDataFrame([(1, "of the"), (2, "the and"), (3, "scum")], "query_id int, term string")
    return S.phrase_search(word_index(spark, sf), phrases)


@query(f"SELECT p.query_id, w.id, count(*) AS n FROM (SELECT id, unnest({D.tokens_sql('content')}) AS term FROM messages) w, (VALUES (1, 'tra'), (2, 'thn'), (3, 'idio')) p(query_id, prefix) WHERE starts_with(w.term, p.prefix) GROUP BY ALL")
def prefix_search(spark, sf):
    prefixes = spark.createDataFrame([(1, "tra"), (2, "thn"), (3, "idio")], "query_id int, prefix string")
    return S.prefix_search(word_index(spark, sf), prefixes)


ASKED_CLAUSES = r"""said AS (SELECT query_id, text, regexp_extract_all(text, '"[^"]*"|&&|\|\||!|[^\s"&|!]+') AS ps FROM asked WHERE regexp_matches(text, '&&|\|\||(^|\W)!|\S\s+NOT\s+\S')),
said_parts AS (SELECT query_id, ps, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM said),
said_ops AS (SELECT *, len(list_filter(ps[1:i], lambda x: x = '||' OR x = 'OR')) AS alt, len(list_filter(ps[1:i], lambda x: x IN ('||', 'OR', '&&', 'AND', '!', 'NOT'))) AS seg,
  list_filter(ps[1:i], lambda x: x IN ('||', 'OR', '&&', 'AND', '!', 'NOT'))[-1] IN ('!', 'NOT') AS negative FROM said_parts)"""


@query(f", {D.ASKED}, {ASKED_CLAUSES} SELECT DISTINCT query_id, CAST(alt AS BIGINT) AS alt, CAST(seg AS BIGINT) AS seg, coalesce(negative, false) AS negative, trim(lower(p), '\"') AS term FROM said_ops WHERE lower(p) NOT IN ('||', 'or', '&&', 'and', '!', 'not')")
def query_clauses(spark, sf):
    """Clauses of queries made of the first words of every message."""
    return Q.query_clauses(D.asked(spark, sf)).select("query_id", "alt", "seg", "negative", "term")


@query(f", {MATCH} SELECT query_id, id FROM met")
def boolean_search(spark, sf):
    return S.boolean_search(word_index(spark, sf), Q.query_clauses(D.queries(spark)))


@query(f"""{PORTER}, stemmed AS (SELECT id, coalesce(stem, t.word) AS term, pos FROM (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM spoken) t LEFT JOIN stems USING (word)),
asked_words AS (SELECT m.id AS query_id, w[1] AS a, w[2] AS b FROM spoken m WHERE len(w) >= 2 AND m.id % 20 = 0),
asked_stems AS (SELECT query_id, coalesce(x.stem, a) AS a, coalesce(y.stem, b) AS b FROM asked_words LEFT JOIN stems x ON x.word = a LEFT JOIN stems y ON y.word = b)
SELECT DISTINCT query_id, p.id FROM asked_stems q JOIN stemmed p ON p.term = q.a JOIN stemmed r ON r.id = p.id AND r.term = q.b AND r.pos = p.pos + 1""")
def stemmed_phrases(spark, sf):
    """The first two words of every twentieth message, as a phrase of stems over a stemmed index."""
    m, w = D.messages(spark, sf), X.tokens(F.col("content"))
    asked = m.where("id % 20 = 0").select(F.col("id").alias("query_id"), w.alias("w")).where("size(w) >= 2").select("query_id", F.format_string('"%s %s"', F.col("w")[0], F.col("w")[1]).alias("text"))
    return S.matches(word_index(spark, sf, "porter"), asked).select("query_id", "id")


@query(f", {MATCH} SELECT query_id, id, score FROM scored")
def matches(spark, sf):
    return S.matches(word_index(spark, sf), D.queries(spark))


@query(f", {FALLBACK} SELECT query_id, id FROM fallback")
def substring_fallback(spark, sf):
    m = D.messages(spark, sf)
    return S.substring_fallback(m, D.queries(spark), S.matches(word_index(spark, sf), D.queries(spark)))


@query("SELECT q.query_id, m.id FROM messages m, (VALUES (1, 'hthnd'), (2, 'of the')) q(query_id, text) WHERE list_has_all([substr(lower(m.content), i, 3) FOR i IN range(1, greatest(length(m.content) - 1, 2))], [substr(q.text, i, 3) FOR i IN range(1, length(q.text) - 1)])")
def trigram_candidates(spark, sf):
    probes = spark.createDataFrame([(1, "hthnd"), (2, "of the")], "query_id int, text string")
    return G.trigram_candidates(D.messages(spark, sf), probes)


@query("SELECT q.query_id, m.id FROM messages m JOIN (SELECT id AS query_id, substr(lower(content), 5, 7) AS probe FROM messages) q ON contains(lower(m.content), q.probe) WHERE length(trim(probe)) = 7 AND q.query_id % 20 = 0")
def substring_search(spark, sf):
    """Seven characters from within every twentieth message, searched by the stored trigrams, or, of
    more probes than are looked up by value, in one pass over the texts."""
    m = D.messages(spark, sf)
    probes = m.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.substring(F.lower("content"), 5, 7).alias("probe")).where("length(trim(probe)) = 7")
    return G.substring_search(m, probes, index=lambda: gram_index(spark, sf))


@query(f", {TERMS}, wanted AS (SELECT query_id, list(DISTINCT term) AS ts FROM terms GROUP BY 1) SELECT query_id, id, session_id, ts FROM wanted, deco WHERE len(list_filter(wanted.ts, lambda t: NOT contains(lower({GEN}), t))) = 0 AND left(ts_iso, 10) >= '2024-01-02'".replace("SELECT query_id, id, session_id, ts FROM", "SELECT query_id, id, session_id, deco.ts FROM"))
def scan_search(spark, sf):
    return S.scan_search(D.messages(spark, sf, True), terms(spark), "2024-01-02")


@query(f", {KEYWORD} SELECT query_id, id, session_id, uuid, score, bm25_rank, coverage, rank FROM keyword")
def keyword_search(spark, sf):
    return keyword(spark, sf)


@query(f", {keyword_sql('m.ts DESC, m.id DESC', 'bm25_rank')} SELECT query_id, id, bm25_rank, coverage, rank FROM keyword")
def keyword_newest(spark, sf):
    return keyword(spark, sf, "newest").select("query_id", "id", "bm25_rank", "coverage", "rank")


@query(f", {keyword_sql('m.ts, m.id', 'bm25_rank')} SELECT query_id, id, bm25_rank, coverage, rank FROM keyword")
def keyword_oldest(spark, sf):
    return keyword(spark, sf, "oldest").select("query_id", "id", "bm25_rank", "coverage", "rank")


@query(f", {KEYWORD}, n AS (SELECT query_id, count(DISTINCT term) AS n_terms FROM terms WHERE query_id NOT IN (SELECT query_id FROM clauses) GROUP BY 1) SELECT query_id, id, CASE WHEN score = 0 THEN 'substring' WHEN n_terms > 1 THEN 'coverage+bm25' ELSE 'bm25' END AS method, coverage, CASE WHEN score = 0 THEN -1 ELSE bm25_rank END AS bm25_rank, false AS recency, rank AS final_rank FROM keyword LEFT JOIN n USING (query_id)")
def explain_search(spark, sf):
    return S.explain_search(keyword(spark, sf), D.queries(spark))


@query(f", {MATCH} SELECT query_id, project, count(*) AS n_hits, max_by(m.id, m.ts_iso || lpad(CAST(m.id AS VARCHAR), 20, '0')) AS id, max(m.ts_iso) AS ts_iso FROM scored JOIN messages m USING (id) JOIN sessions s ON m.session_id = s.id AND NOT is_subagent GROUP BY query_id, project")
def search_all_projects(spark, sf):
    return S.search_all_projects(D.messages(spark, sf), D.sessions(spark, sf), D.queries(spark), word_index(spark, sf))


@query(f", {KEYWORD} SELECT query_id, rank, id, count(*) OVER (PARTITION BY query_id) AS total, rank <= 3 AND count(*) OVER (PARTITION BY query_id) > 3 AS has_more FROM keyword QUALIFY rank <= 3")
def envelope(spark, sf):
    return S.envelope(keyword(spark, sf), 3).select("query_id", "rank", "id", "total", "has_more")


ROOTS = """walk(id, top, hops) AS (SELECT id, id, 0 FROM sessions UNION ALL SELECT w.id, s.parent_id, hops + 1 FROM walk w JOIN sessions s ON w.top = s.id WHERE s.parent_id IS NOT NULL AND hops < 64),
roots AS (SELECT id, max_by(top, hops) AS root FROM walk GROUP BY id)"""


@query(f", {ROOTS} SELECT id, root FROM roots")
def lineage_root(spark, sf):
    return O.lineage_root(D.sessions(spark, sf))


DEDUP = f"""{KEYWORD}, {ROOTS}, dedup AS (SELECT query_id, id, session_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM
 (SELECT k.*, row_number() OVER (PARTITION BY query_id, s.project, r.root ORDER BY rank) AS n FROM keyword k LEFT JOIN roots r ON k.session_id = r.id LEFT JOIN sessions s ON k.session_id = s.id WHERE uuid <> '') WHERE n = 1)"""


def deduped(spark, sf):
    s = D.sessions(spark, sf)
    return S.dedup_lineage(keyword(spark, sf), O.lineage_root(s), s).withColumn("rank", F.col("rank").cast("long"))


@query(f", {DEDUP} SELECT query_id, id, session_id, rank FROM dedup")
def dedup_lineage(spark, sf):
    return deduped(spark, sf).select("query_id", "id", "session_id", "rank")


@query(f", {KEYWORD}, callers AS (SELECT query_id, min(session_id) AS caller FROM keyword GROUP BY 1), turns AS (SELECT session_id, max(id) AS turn_start FROM messages WHERE {D.human_sql('role', 'content')} GROUP BY 1) SELECT query_id, id FROM keyword k WHERE NOT EXISTS (SELECT 1 FROM callers c JOIN turns t ON c.caller = t.session_id WHERE c.query_id = k.query_id AND c.caller = k.session_id AND k.id >= t.turn_start)")
def drop_current_turn(spark, sf):
    hits = keyword(spark, sf)
    callers = hits.groupBy("query_id").agg(F.min("session_id").alias("caller_session"))
    return S.drop_current_turn(hits, D.messages(spark, sf), callers).select("query_id", "id")


@query(f", {KEYWORD} SELECT query_id, array_to_string(list_filter([CASE WHEN {NOW} - max(ts) > 86400 THEN 'recency_skew' END, CASE WHEN count(*) >= 20 THEN 'broad_query' END, CASE WHEN count(DISTINCT project) >= 2 THEN 'project_spread' END], lambda x: x IS NOT NULL), ',') AS codes FROM keyword k JOIN messages m USING (id) JOIN sessions s ON k.session_id = s.id GROUP BY query_id")
def search_warnings(spark, sf):
    return S.search_warnings(keyword(spark, sf), D.sessions(spark, sf), D.messages(spark, sf), NOW)


@query(f", {KEYWORD}, h AS (SELECT project, count(*) AS n_hits FROM keyword k JOIN sessions s ON k.session_id = s.id GROUP BY 1) SELECT project, count(*) AS n_sessions, 'searched' AS status, coalesce(any_value(n_hits), 0) AS n_hits, true AS complete FROM sessions LEFT JOIN h USING (project) GROUP BY project")
def scope_report(spark, sf):
    return S.scope_report(D.sessions(spark, sf), keyword(spark, sf), D.messages(spark, sf))


@query(f", {KEYWORD} SELECT query_id, count(DISTINCT k.session_id) AS n_sessions, count(DISTINCT project) AS n_projects, array_to_string(list_sort(list(DISTINCT project))[1:5], ',') AS sample FROM keyword k JOIN sessions s ON k.session_id = s.id GROUP BY query_id")
def project_spread(spark, sf):
    return S.project_spread(keyword(spark, sf), D.sessions(spark, sf))


PREVIEW = f"""previews AS (SELECT session_id, left(coalesce(min_by(c, id) FILTER (NOT {D.low_signal_sql('c')}), min_by(c, id)), 70) AS preview FROM
 (SELECT session_id, id, c, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM (SELECT session_id, id, {GEN} AS c FROM messages WHERE role = 'user') WHERE c <> '') WHERE n <= 8 GROUP BY session_id)"""
ACTIVITY = f"""activity AS (SELECT session_id, left(coalesce(max_by({GEN}, id) FILTER ({D.displayable_sql('content')}), ''), 70) AS activity FROM
 (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n FROM messages WHERE trim(content) <> '') WHERE n <= 40 GROUP BY session_id)"""
SEGS = """segs AS (SELECT session_id, topic, start_id, CASE WHEN start_id % 2 = 0 THEN start_id + 1 END AS end_id FROM segments)"""
TOPICS = f"""{SEGS}, topics AS (SELECT m.id, coalesce((SELECT max_by(CASE WHEN end_id IS NULL OR m.id <= end_id THEN topic END, start_id) FROM (SELECT * FROM segs s WHERE s.session_id = m.session_id AND s.start_id <= m.id ORDER BY start_id DESC LIMIT 1)), (SELECT min(topic) FROM segs s WHERE s.session_id = m.session_id HAVING count(*) = 1)) AS topic FROM messages m)"""


def segs(spark, sf):
    return D.segments(spark, sf).select("session_id", "topic", "start_id", F.when(F.col("start_id") % 2 == 0, F.col("start_id") + 1).alias("end_id"))


@query(f", {TOPICS} SELECT id, topic FROM topics")
def topic_for_message(spark, sf):
    return T.topic_for_message(D.messages(spark, sf), segs(spark, sf))


@query(f", {DEDUP}, {PREVIEW}, {ACTIVITY}, {TOPICS} SELECT query_id, rank, d.id, d.session_id, coalesce(topic, preview) AS label, activity FROM dedup d LEFT JOIN topics t ON d.id = t.id LEFT JOIN previews USING (session_id) LEFT JOIN activity USING (session_id)")
def search(spark, sf):
    m = D.messages(spark, sf)
    return T.annotate_hits(deduped(spark, sf).select("query_id", "rank", "id", "session_id"), T.topic_for_message(m, segs(spark, sf)), O.session_preview(m), O.last_activity(m))


MSG_VECTORS = "msg_vectors AS (SELECT (vec_id // 4) * 1000 + vec_id % 4 AS msg_id, lpad(CAST(vec_id // 4 AS VARCHAR), 8, '0') AS session_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
NEAR = f"""{MSG_VECTORS}, qv AS (SELECT query_id, CAST(embedding AS DOUBLE[]) AS q FROM queries JOIN embeddings ON vec_id = 7 * query_id),
sims AS (SELECT query_id, msg_id, session_id, round(list_dot_product(vec, q) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(q, q))), 9) AS similarity FROM msg_vectors, qv WHERE len(vec) = len(q)),
first_near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, msg_id DESC, session_id DESC) AS place FROM sims QUALIFY place <= 24),
near AS (SELECT n.query_id, m.id, m.session_id, n.similarity, row_number() OVER (PARTITION BY n.query_id ORDER BY place) AS rank FROM first_near n JOIN messages m ON m.id = n.msg_id JOIN sessions s ON s.id = m.session_id AND NOT s.is_subagent QUALIFY rank <= 8)"""


def near_inputs(spark, sf):
    e = D.table(spark, sf, "embeddings")
    n = F.col("vec_id")
    vectors = e.select((F.floor(n / 4) * 1000 + n % 4).alias("msg_id"), F.lpad(F.floor(n / 4).cast("string"), 8, "0").alias("session_id"), F.col("embedding").alias("vec"))
    asked = D.queries(spark).join(e, F.col("vec_id") == 7 * F.col("query_id")).select("query_id", F.col("embedding").alias("qvec"))
    return vectors, asked


@query(f", {NEAR} SELECT query_id, id, session_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM near")
def nearest_messages(spark, sf):
    vectors, asked = near_inputs(spark, sf)
    return R.nearest_messages(vectors, asked, D.messages(spark, sf), D.sessions(spark, sf), 8).withColumn("similarity", F.round("similarity", 6))


FULL = f"""{KEYWORD}, {ROOTS}, {NEAR}, turns AS (SELECT session_id, max(id) AS turn_start FROM messages WHERE {D.human_sql('role', 'content')} GROUP BY 1),
callers AS (SELECT query_id, min(session_id) AS caller FROM keyword GROUP BY 1),
fused AS (SELECT coalesce(k.query_id, n.query_id) AS query_id, coalesce(k.id, n.id) AS id, coalesce(coverage, 0) AS coverage, round(coalesce(1.0 / (60 + k.rank), 0) + coalesce(1.0 / (60 + n.rank), 0), 9) AS fused FROM keyword k FULL JOIN near n ON k.query_id = n.query_id AND k.id = n.id),
placed_hits AS (SELECT f.*, m.session_id, m.uuid, m.ts_iso, row_number() OVER (PARTITION BY f.query_id ORDER BY fused DESC, f.id) AS place FROM fused f JOIN messages m USING (id)),
at_most AS (SELECT query_id, count(*) >= 8 AS at_ceiling FROM placed_hits GROUP BY 1),
own AS (SELECT h.query_id, h.id FROM placed_hits h JOIN callers c ON c.query_id = h.query_id AND c.caller = h.session_id JOIN turns t ON t.session_id = c.caller WHERE h.id >= t.turn_start),
ordered AS (SELECT h.*, row_number() OVER (PARTITION BY h.query_id ORDER BY fused DESC, coverage DESC, place, h.id) AS n FROM placed_hits h ANTI JOIN own o ON o.query_id = h.query_id AND o.id = h.id),
single AS (SELECT o.*, s.project, s.missing_since IS NOT NULL AS missing FROM ordered o LEFT JOIN roots r ON r.id = o.session_id LEFT JOIN sessions s ON s.id = o.session_id WHERE uuid <> '' QUALIFY row_number() OVER (PARTITION BY query_id, s.project, r.root ORDER BY n) = 1),
full_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM single)"""


def searched(spark, sf):
    """Search by words and vectors, with its candidates and callers, each found once; a query's
    caller is the first session that words find."""
    m, s, asked = D.messages(spark, sf), D.sessions(spark, sf), D.queries(spark)
    vectors, query_vectors = near_inputs(spark, sf)
    callers = written(keyword(spark, sf).groupBy("query_id").agg(F.min("session_id").alias("caller_session")), "callers")
    before = written(R.candidates(m, s, asked, 8, index=word_index(spark, sf), vectors=vectors, query_vectors=query_vectors), "candidates")
    return R.full_search(m, s, asked, 3, 8, callers=callers, found=before), before, callers


@query(f", {FULL} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, session_id, project, left(session_id, 8) || ':' || left(uuid, 8) AS read_ref, ts_iso, missing, fused, total, total > 3 OR at_ceiling AS has_more, CASE WHEN total > 3 OR at_ceiling THEN 20 END AS widen_to, at_ceiling FROM full_hits JOIN at_most USING (query_id) WHERE rank <= 3")
def full_search(spark, sf):
    return searched(spark, sf)[0]


STATES = "states AS (SELECT project AS scope, CASE project WHEN 'p1' THEN 'skipped_error' WHEN 'p2' THEN 'stale_fallback' WHEN 'p3' THEN 'not_consolidated' WHEN 'p4' THEN 'empty' ELSE 'searched' END AS state FROM (SELECT DISTINCT project FROM sessions))"


def scopes(spark, sf):
    s = D.sessions(spark, sf).groupBy("project").agg(F.sum("message_count").alias("n"))
    p = F.col("project")
    return s.select(p.alias("scope"), (p != "p3").alias("in_store"), F.when(p.isin("p1", "p2"), "no lock").alias("error"), (p == "p2").alias("busy"), F.when(p == "p4", 0).otherwise(F.col("n")).alias("n_rows"))


@query(f", {STATES} SELECT scope, state, CASE WHEN scope IN ('p1', 'p2') THEN 'no lock' END AS detail, state IN ('searched', 'empty') AS complete FROM states")
def scope_states(spark, sf):
    return R.scope_states(scopes(spark, sf))


@query(f""", {FULL}, {STATES}, shown AS (SELECT * FROM full_hits WHERE rank <= 3),
per AS (SELECT query_id, max(ts_iso) AS newest, min_by(ts_iso, rank) AS top, max(total) AS total, any_value(at_ceiling) AS ceiling, count(DISTINCT project) AS projects, array_to_string(list_sort(list(DISTINCT project))[1:5], ',') AS sample FROM shown JOIN at_most USING (query_id) GROUP BY query_id),
gone AS (SELECT query_id, count(*) AS dropped FROM own GROUP BY 1),
st AS (SELECT count(*) AS scopes, count(*) FILTER (state = 'skipped_error') AS e, count(*) FILTER (state = 'stale_fallback') AS f, count(*) FILTER (state = 'not_consolidated') AS u FROM states)
SELECT query_id, 0 AS ord, 'recency_skew' AS code, left(newest, 10) AS detail FROM per WHERE CAST(replace(rtrim(newest, 'Z'), 'T', ' ') AS TIMESTAMP) - CAST(replace(rtrim(top, 'Z'), 'T', ' ') AS TIMESTAMP) > INTERVAL 1 DAY
UNION ALL SELECT query_id, 1, 'broad_query', CAST(total AS VARCHAR) FROM per WHERE ceiling OR total >= 20
UNION ALL SELECT query_id, 2, 'current_turn_excluded', CAST(dropped AS VARCHAR) FROM per JOIN gone USING (query_id)
UNION ALL SELECT query_id, 3, 'scope_incomplete', scopes || ',' || e || ',' || f FROM per, st WHERE e + f > 0
UNION ALL SELECT query_id, 4, 'not_consolidated', CAST(u AS VARCHAR) FROM per, st WHERE u > 0
UNION ALL SELECT query_id, 5, 'store_fallback', 'store busy' FROM per
UNION ALL SELECT query_id, 6, 'project_spread', projects || ',' || sample FROM per WHERE projects >= 2
UNION ALL SELECT query_id, 7, 'raw_history', NULL FROM per""")
def advisories(spark, sf):
    found, before, callers = searched(spark, sf)
    dropped = before.join(S.drop_current_turn(before, D.messages(spark, sf), callers).select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("n"))
    return R.advisories(found, R.scope_states(scopes(spark, sf)), dropped=dropped, store_note="store busy")


# Sessions and views


@query("SELECT session_id, min(nullif(ts, 0)) AS started_at, max(nullif(ts, 0)) AS last_ts, count(*) AS message_count FROM messages GROUP BY session_id")
def build_sessions(spark, sf):
    return O.build_sessions(D.messages(spark, sf))


@query("SELECT count(*) FILTER (NOT is_subagent) AS top_level, count(*) FILTER (is_subagent) AS subagents, any_value(m.messages) AS messages, any_value(m.u) AS user_messages, any_value(m.a) AS assistant_messages, any_value(f) AS first_day, any_value(l) AS last_day FROM sessions, (SELECT count(*) AS messages, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, min(left(ts_iso, 10)) AS f, max(left(ts_iso, 10)) AS l FROM messages) m")
def corpus_stats(spark, sf):
    return O.corpus_stats(D.messages(spark, sf), D.sessions(spark, sf))


@query("SELECT project, count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages FROM sessions GROUP BY ROLLUP (project)")
def fleet_stats(spark, sf):
    return O.fleet_stats(D.messages(spark, sf), D.sessions(spark, sf))


@query("SELECT count(*) AS all_sessions, count(*) FILTER (NOT is_subagent) AS top_level FROM sessions")
def session_counts(spark, sf):
    return O.session_counts(D.sessions(spark, sf))


@query("SELECT project, n_sessions, CAST(row_number() OVER (ORDER BY n_sessions DESC, project) AS INTEGER) AS rank FROM (SELECT project, count(*) AS n_sessions FROM sessions WHERE NOT is_subagent GROUP BY 1)")
def list_projects(spark, sf):
    return O.list_projects(D.sessions(spark, sf))


@query("SELECT DISTINCT project, cwd FROM sessions")
def distinct_scopes(spark, sf):
    return O.distinct_scopes(D.sessions(spark, sf))


@query("SELECT id, project, last_ts FROM sessions WHERE NOT is_subagent AND strftime(make_timestamp(CAST(last_ts AS BIGINT) * 1000000), '%Y-%m-%d') <= '2024-01-03' ORDER BY last_ts DESC, id LIMIT 20")
def browse(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return O.browse(D.sessions(spark, sf), 20, None, "2024-01-03").select("id", "project", "last_ts")


@query(f"SELECT id, project, message_count, greatest(0, {NOW} - last_ts) AS age FROM sessions ORDER BY last_ts DESC, id LIMIT 20")
def live_sessions(spark, sf):
    return O.live_sessions(D.sessions(spark, sf), NOW)


@query("SELECT session_id, id, role, CAST(back AS INTEGER) AS back, total, age FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back, count(*) OVER (PARTITION BY session_id) AS total, greatest(0, 1.705e9 - max(ts) OVER (PARTITION BY session_id)) AS age FROM messages) WHERE back <= 3")
def session_tail(spark, sf):
    m = D.messages(spark, sf)
    return O.session_tail(m, m.select("session_id"), 3, 1.705e9)


@query("SELECT DISTINCT parent_id AS parent, id AS child FROM sessions WHERE is_subagent AND parent_id IS NOT NULL")
def subagents(spark, sf):
    return O.subagents(D.sessions(spark, sf))


@query(f"SELECT session_id, left(min_by({GEN}, id) FILTER (role = 'user' AND NOT {D.low_signal_sql(GEN)}), 80) AS title FROM messages GROUP BY session_id")
def derive_title(spark, sf):
    return O.derive_title(D.messages(spark, sf))


@query(f", {PREVIEW} SELECT session_id, preview FROM previews")
def session_preview(spark, sf):
    return O.session_preview(D.messages(spark, sf))


@query(f", {ACTIVITY} SELECT session_id, activity FROM activity")
def last_activity(spark, sf):
    return O.last_activity(D.messages(spark, sf))


WINDOW = """placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn, count(*) OVER (PARTITION BY session_id) AS size FROM messages),
anchors AS (SELECT id AS ref_id, session_id, id AS anchor, rn AS centre FROM placed WHERE id % 17 = 0),
win AS (SELECT ref_id, p.session_id, p.id, role, CASE WHEN p.id = anchor THEN content ELSE left(content, 200) END AS text, p.id = anchor AS is_anchor, CAST(rn - centre AS INTEGER) AS ord, greatest(0, centre - 4) AS before, greatest(0, size - centre - 3) AS after
 FROM placed p JOIN anchors a USING (session_id) WHERE abs(rn - centre) <= 3 AND (p.id = anchor OR role IN ('user', 'assistant')))"""


def window(spark, sf):
    m = D.messages(spark, sf)
    return O.anchored_window(m, m.where("id % 17 = 0").select(F.col("id").alias("ref_id"), "session_id", "id"))


@query(f", {WINDOW} SELECT ref_id, session_id, id, role, text, is_anchor, ord, before, after FROM win")
def anchored_window(spark, sf):
    return window(spark, sf).withColumns({"before": F.col("before").cast("long"), "after": F.col("after").cast("long")})


BUDGET = f"""{WINDOW}, sums AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY ref_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM win),
cut AS (SELECT *, b + length(text) > 500 AS truncated, CASE WHEN b + length(text) > 500 THEN left(text, CAST(500 - b AS BIGINT)) || ' …[truncated]' ELSE text END AS t FROM sums WHERE b < 500)"""


@query(f", {BUDGET} SELECT ref_id, id, t AS text, truncated, CAST(b + length(t) AS BIGINT) AS used FROM cut")
def apply_budget(spark, sf):
    return O.apply_budget(window(spark, sf), 500).select("ref_id", "id", "text", "truncated", F.col("used").cast("long").alias("used"))


ENDS = f"""talk AS (SELECT session_id, id, content, row_number() OVER (PARTITION BY session_id ORDER BY id) AS up, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS down FROM messages WHERE role IN ('user', 'assistant')),
s AS (SELECT session_id, 'start' AS section, row_number() OVER (PARTITION BY session_id ORDER BY id) AS ord, id FROM talk WHERE up <= 40 AND {D.displayable_sql('content')} QUALIFY ord <= 4),
e AS (SELECT session_id, 'end' AS section, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS ord, id FROM talk WHERE down <= 40 AND {D.displayable_sql('content')} QUALIFY ord <= 4),
ends AS (SELECT * FROM s UNION ALL SELECT * FROM e WHERE id NOT IN (SELECT id FROM s))"""


@query(f", {ENDS} SELECT session_id, section, CAST(ord AS INTEGER) AS ord, id FROM ends")
def bookends(spark, sf):
    return O.bookends(D.messages(spark, sf))


@query(f", {ENDS}, b AS (SELECT session_id, count(*) FILTER (section = 'start') AS n_start, count(*) FILTER (section = 'end') AS n_end, max(id) FILTER (section = 'start') AS lo, min(id) FILTER (section = 'end') AS hi FROM ends GROUP BY 1) SELECT b.session_id, n_start, n_end, count(*) FILTER (m.id > lo AND m.id < hi) AS n_middle, (SELECT count(*) FROM segments g WHERE g.session_id = b.session_id) AS n_topics, (SELECT count(*) FROM sessions c WHERE c.is_subagent AND c.parent_id = b.session_id) AS n_subagents FROM b JOIN messages m USING (session_id) GROUP BY ALL")
def outline(spark, sf):
    return O.outline(D.messages(spark, sf), D.segments(spark, sf), D.sessions(spark, sf))


def refs(spark, sf):
    m = D.messages(spark, sf).where("id % 17 = 0")
    ref = F.when(F.col("id") % 3 == 0, F.concat(F.lit("ref="), X.read_ref(F.col("session_id"), F.col("uuid")))).when(F.col("id") % 5 == 0, F.col("session_id")).when(F.col("id") % 7 == 0, F.concat(F.left("session_id", F.lit(7)), F.lit(":"), F.left("uuid", F.lit(8)))).otherwise(F.concat(F.left("session_id", F.lit(8)), F.lit(":ffffffffffff")))
    return m.select(F.col("id").alias("ref_id"), ref.alias("ref"))


REFS = """refs AS (SELECT id AS ref_id, CASE WHEN id % 3 = 0 THEN 'ref=' || left(session_id, 8) || ':' || left(uuid, 8) WHEN id % 5 = 0 THEN session_id WHEN id % 7 = 0 THEN left(session_id, 7) || ':' || left(uuid, 8) ELSE left(session_id, 8) || ':ffffffffffff' END AS ref FROM messages WHERE id % 17 = 0),
parsed AS (SELECT ref_id, split_part(regexp_replace(ref, '^ref=', ''), ':', 1) AS session_ref, lower(split_part(ref, ':', 2)) AS uuid_ref, CASE WHEN NOT contains(ref, ':') THEN 'invalid' WHEN regexp_matches(split_part(ref, ':', 2), '^[0-9]{1,7}$') THEN 'legacy' ELSE 'ok' END AS status FROM refs),
owner AS (SELECT ref_id, uuid_ref, CASE WHEN count(s.id) FILTER (NOT is_subagent) > 0 THEN count(s.id) FILTER (NOT is_subagent) ELSE count(s.id) END AS n, coalesce(min(s.id) FILTER (NOT is_subagent), min(s.id)) AS session_id FROM parsed LEFT JOIN sessions s ON starts_with(s.id, session_ref) WHERE status = 'ok' GROUP BY 1, 2),
found AS (SELECT ref_id, o.session_id, count(m.id) AS k, min(m.id) AS id FROM owner o LEFT JOIN messages m ON m.session_id = o.session_id AND starts_with(m.uuid, uuid_ref) WHERE n = 1 GROUP BY 1, 2),
resolved AS (SELECT ref_id, session_id, CASE WHEN k = 1 THEN id END AS id, CASE k WHEN 1 THEN 'ok' WHEN 0 THEN 'not_found' ELSE 'ambiguous' END AS status FROM found
 UNION ALL SELECT ref_id, NULL, NULL, CASE n WHEN 0 THEN 'not_found' ELSE 'ambiguous' END FROM owner WHERE n <> 1 UNION ALL SELECT ref_id, NULL, NULL, status FROM parsed WHERE status <> 'ok')"""


@query(f", {REFS} SELECT ref_id, session_ref, uuid_ref, status FROM parsed")
def parse_refs(spark, sf):
    return O.parse_refs(refs(spark, sf))


@query(f", {REFS} SELECT ref_id, session_id, id, status FROM resolved")
def resolve_refs(spark, sf):
    return O.resolve_refs(refs(spark, sf), D.sessions(spark, sf), D.messages(spark, sf))


@query(f", {REFS}, {BUDGET.replace('WHERE id % 17 = 0)', 'JOIN resolved r USING (session_id, id) WHERE r.status = chr(111) || chr(107))').replace('id AS ref_id, session_id', 'r.ref_id, session_id').replace('500', '2000')} SELECT ref_id, session_id, id, ord, is_anchor, truncated, CAST(b + length(t) AS BIGINT) AS used, before, after FROM cut")
def read_refs(spark, sf):
    return O.read_refs(refs(spark, sf), D.sessions(spark, sf), D.messages(spark, sf)).withColumns({c: F.col(c).cast("long") for c in ("used", "before", "after")})


FULL_READ = BUDGET.replace('WHERE id % 17 = 0)', 'JOIN resolved r USING (session_id, id) WHERE r.status = chr(111) || chr(107))').replace('id AS ref_id, session_id', 'r.ref_id, session_id').replace('500', '2000')


@query(f""", {REFS}, {FULL_READ}, {ENDS}, ok AS (SELECT ref_id, session_id FROM resolved WHERE status = 'ok'),
two AS (SELECT * FROM s WHERE ord <= 2 UNION ALL SELECT * FROM e WHERE ord <= 2 AND id NOT IN (SELECT id FROM s WHERE ord <= 2)),
book AS (SELECT ref_id, section, ord, t.id, left({GEN.replace('content', 'm.content')}, 200) AS text FROM ok JOIN two t USING (session_id) JOIN messages m ON m.id = t.id WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.ref_id = ok.ref_id AND c.id = t.id)),
hit AS (SELECT ref_id, min_by(t, ord) AS text FROM cut WHERE contains(lower(t), 'th') GROUP BY 1), spot AS (SELECT *, instr(lower(text), 'th') AS a FROM hit),
seen AS (SELECT ref_id, 'window' AS section, ord, id, t AS text FROM cut UNION ALL SELECT * FROM book
 UNION ALL SELECT ref_id, 'focus', 0, NULL, {D.clean_sql("regexp_replace(substr(text, greatest(a - 60, 1), a + 120 - greatest(a - 60, 1)), '(th)', '>>>\\1<<<', 'gi')")} FROM spot)
SELECT ref_id, section, CAST(ord AS INTEGER) AS ord, seen.id, text, (SELECT count(*) FROM sessions c WHERE c.is_subagent AND c.parent_id = ok.session_id) AS n_subagents FROM seen JOIN ok USING (ref_id)""")
def read_full(spark, sf):
    asked = refs(spark, sf)
    return O.read_full(asked, D.sessions(spark, sf), D.messages(spark, sf), needles=asked.select("ref_id", F.lit("Th").alias("needle")))


@query(f", {WINDOW.replace('rn AS centre', 'rn + 2 AS centre').replace('<= 3', '<= 16').replace('centre - 4', 'centre - 17').replace('centre - 3', 'centre - 16')} SELECT ref_id, id, ord, before, after FROM win")
def widened_window(spark, sf):
    """Windows re-centred two rows on and widened by one level."""
    m = D.messages(spark, sf)
    rows = O.anchored_window(m, m.where("id % 17 = 0").select(F.col("id").alias("ref_id"), "session_id", "id"), around=2, more=1)
    return rows.select("ref_id", "id", "ord", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))


@query(f", {WINDOW}, f AS (SELECT ref_id, min_by(text, ord) AS text FROM win WHERE contains(lower(text), 'tion') GROUP BY 1), p AS (SELECT ref_id, text, instr(lower(text), 'tion') AS a FROM f) SELECT ref_id, {D.clean_sql('''regexp_replace(substr(text, greatest(a - 60, 1), a + 120 - greatest(a - 60, 1)), '(tion)', '>>>\\1<<<', 'gi')''')} AS focus FROM p")
def focus_snippet(spark, sf):
    w = window(spark, sf)
    return O.focus_snippet(w, w.select("ref_id", F.lit("Tion").alias("needle")).distinct())


@query("SELECT m.id FROM messages m JOIN sessions s ON m.session_id = s.id WHERE NOT is_subagent AND role = 'user' AND message_count >= 3 AND project IN ('p1', 'p2', 'p3')")
def scope_filter(spark, sf):
    return S.scope_filter(D.messages(spark, sf), D.sessions(spark, sf), role="user", least_messages=3, projects=["p1", "p2", "p3"]).select("id")


@query("SELECT id FROM messages WHERE left(ts_iso, 10) BETWEEN '2024-01-02' AND '2024-01-03'")
def date_bounds(spark, sf):
    return S.date_bounds(D.messages(spark, sf), "2024-01-02", "2024-01-03").select("id")


@query("SELECT id, project FROM sessions WHERE regexp_matches(cwd, '/p[1-4]$') AND NOT contains(cwd, 'p2')")
def path_scope(spark, sf):
    return S.path_scope(D.sessions(spark, sf), "/p[1-4]$", "p2").select("id", "project")


@query(f""", {KEYWORD}, term_words AS (SELECT query_id, list(DISTINCT w) AS ws FROM (SELECT query_id, unnest({D.tokens_sql('term')}) AS w FROM terms) GROUP BY 1),
cut AS (SELECT k.query_id, k.id, ws, {D.tokens_sql('content')} AS w FROM keyword k JOIN term_words USING (query_id) JOIN messages m ON m.id = k.id),
runs AS (SELECT *, unnest(list_transform(list_filter(range(len(w)), lambda i: list_contains(ws, w[i + 1])), lambda i: least(i, greatest(len(w) - 16, 0)))) AS i FROM cut),
best AS (SELECT query_id, id, w, ws, arg_min(i, -100000.0 * len(list_intersect(w[i + 1:i + 16], ws)) + i) AS i FROM runs GROUP BY ALL)
SELECT query_id, id, CASE WHEN i > 0 THEN '…' ELSE '' END || array_to_string(list_transform(w[i + 1:i + 16], lambda x: CASE WHEN list_contains(ws, x) THEN '>>>' || x || '<<<' ELSE x END), ' ') || CASE WHEN i + 16 < len(w) THEN '…' ELSE '' END AS words FROM best""")
def token_snippet(spark, sf):
    """Snippets of the hits by words; compared as their folded words."""
    rows = S.token_snippet(keyword(spark, sf), D.messages(spark, sf), terms(spark))
    return rows.select("query_id", "id", F.regexp_replace(F.regexp_replace(X.fold(F.col("snippet")), r"[^\p{L}\p{N}…<>]+", " "), "> *>>>", ">>>").alias("words"))


@query("SELECT (SELECT count(*) FROM embeddings) > 0 AS has_vectors, (SELECT count(*) FROM segments) + (SELECT count(*) FROM verdicts) > 0 AS has_topics, (SELECT count(*) FROM segments WHERE topic <> '') > 0 AS has_real_segments")
def exists_probes(spark, sf):
    return S.exists_probes(D.table(spark, sf, "embeddings"), D.segments(spark, sf), D.verdicts(spark, sf))


# Vectors


@query(f"SELECT session_id, left(sha1(t), 16) AS content_hash, max(id) AS msg_id, max(t) AS text FROM (SELECT session_id, id, {GEN} AS t FROM deco) WHERE length(t) >= 12 GROUP BY session_id, t")
def vector_corpus(spark, sf):
    return V.vector_corpus(D.messages(spark, sf, True))


@query(f", vc AS (SELECT session_id, left(sha1(t), 16) AS content_hash, max(id) AS msg_id FROM (SELECT session_id, id, {GEN} AS t FROM deco) WHERE length(t) >= 12 GROUP BY session_id, t), old AS (SELECT session_id, content_hash, CASE WHEN msg_id % 3 = 0 THEN msg_id - 1 ELSE msg_id END AS old_id FROM vc WHERE msg_id % 4 <> 0 UNION ALL SELECT session_id, 'gone', id FROM messages WHERE id % 5 = 0) SELECT session_id, content_hash, coalesce(msg_id, old_id) AS msg_id, CASE WHEN old_id IS NULL THEN 'embed' WHEN msg_id IS NULL THEN 'prune' WHEN old_id <> msg_id THEN 'repoint' ELSE 'keep' END AS action FROM vc FULL JOIN old USING (session_id, content_hash)")
def vector_delta(spark, sf):
    corpus = V.vector_corpus(D.messages(spark, sf, True)).drop("text")
    old = corpus.where("msg_id % 4 <> 0").select("session_id", "content_hash", F.when(F.col("msg_id") % 3 == 0, F.col("msg_id") - 1).otherwise(F.col("msg_id")).alias("msg_id"))
    gone = D.messages(spark, sf).where("id % 5 = 0").select("session_id", F.lit("gone").alias("content_hash"), F.col("id").alias("msg_id"))
    return V.vector_delta(corpus, old.union(gone))


def hashed(texts: list[str]) -> list[list[float] | None]:
    """A stand-in embedder: letter counts of each text."""
    return [[float(t.lower().count(c)) for c in "abcdefghijklmnop"] for t in texts]


@query("SELECT session_id, content_hash, msg_id, CAST(len(t) - len(replace(lower(t), 'e', '')) AS DOUBLE) AS e_count FROM (SELECT session_id, left(sha1(t), 16) AS content_hash, max(id) AS msg_id, t FROM (SELECT session_id, id, " + GEN + " AS t FROM deco) WHERE length(t) >= 12 GROUP BY session_id, t)")
def embed_corpus(spark, sf):
    rows = V.embed_corpus(V.vector_corpus(D.messages(spark, sf, True)), hashed)
    return rows.select("session_id", "content_hash", "msg_id", F.element_at("vec", 5).cast("double").alias("e_count"))


KNN = """knn AS (SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id DESC) AS rank FROM
 (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 9) AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0))"""


def knn(spark, sf, k):
    e = D.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return V.vector_knn(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")), k)


@query(f"WITH {KNN} SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM knn WHERE rank <= 10", base=False)
def vector_knn(spark, sf):
    return knn(spark, sf, 10).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {KNN}, a AS (SELECT query_id, vec_id AS id, rank FROM knn WHERE rank <= 10), b AS (SELECT query_id, vec_id AS id, 21 - rank AS rank FROM knn WHERE rank BETWEEN 6 AND 20) SELECT query_id, id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score, a.rank IS NOT NULL AS in_keyword, b.rank IS NOT NULL AS in_vector FROM a FULL JOIN b USING (query_id, id)", base=False)
def rrf_fuse(spark, sf):
    n = written(knn(spark, sf, 20).select("query_id", F.col("vec_id").alias("id"), "rank"), "nearest")  # both lists are read from it
    return V.rrf_fuse(n.where("rank <= 10"), n.where("rank >= 6").withColumn("rank", 21 - F.col("rank"))).drop("rank")


@query(f", {KEYWORD} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ts_iso DESC, rank) AS INTEGER) AS final_rank FROM keyword JOIN messages USING (id)")
def rank_candidates(spark, sf):
    hits = keyword(spark, sf).join(D.messages(spark, sf).select("id", "ts_iso"), "id").withColumn("fused", F.col("score"))
    return V.rank_candidates(hits, "newest").select("query_id", "id", "final_rank")


# Merge, retention, deletion

MERGED = """copies_0 AS (SELECT *, 0 AS store FROM messages UNION ALL SELECT *, 1 FROM second), merged AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY store, id) AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, uuid ORDER BY store, id) AS n FROM copies_0) WHERE n = 1)"""


def both(spark, sf):
    return D.messages(spark, sf).withColumn("store", F.lit(0)).unionByName(D.second_store(spark, sf).withColumn("store", F.lit(1)))


@query(f", {MERGED} SELECT session_id, uuid, id, store, CAST(new_id AS INTEGER) AS new_id FROM merged")
def merge_messages(spark, sf):
    return M.merge_messages(both(spark, sf)).select("session_id", "uuid", "id", "store", "new_id")


@query(f", {MERGED}, copies AS (SELECT *, 0 AS store FROM sessions UNION ALL SELECT id, started_at - 10, last_ts + 60, message_count + 1, is_subagent, NULL, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN NULL ELSE 'q' || right(id, 1) END, cwd, 'delta', origin_machine, NULL, 1 FROM sessions WHERE CAST(id AS BIGINT) % 2 = 0) SELECT c.id, min(started_at) FILTER (started_at > 0) AS started_at, max(last_ts) AS last_ts, bool_or(is_subagent) AS is_subagent, arg_min(parent_id, store) AS parent_id, arg_min(source_tool, store) AS source_tool, arg_max(project, (CASE WHEN missing_since IS NULL THEN 1e9 ELSE 0 END) + message_count * 10 - store) FILTER (project IS NOT NULL) AS project, CASE WHEN count(missing_since) = count(*) THEN min(missing_since) END AS missing_since, any_value(k) AS message_count FROM copies c JOIN (SELECT session_id, count(*) AS k FROM merged GROUP BY 1) g ON g.session_id = c.id GROUP BY c.id")
def merge_sessions(spark, sf):
    s = D.sessions(spark, sf)
    n = F.col("id").cast("long")
    other = s.where(n % 2 == 0).select("id", (F.col("started_at") - 10).alias("started_at"), (F.col("last_ts") + 60).alias("last_ts"), (F.col("message_count") + 1).alias("message_count"), "is_subagent", F.lit(None).cast("string").alias("parent_id"), F.when(n % 3 != 0, F.concat(F.lit("q"), F.right("id", F.lit(1)))).alias("project"), "cwd", F.lit("delta").alias("source_tool"), "origin_machine", F.lit(None).cast("double").alias("missing_since"), F.lit(1).alias("store"))
    rows = M.merge_sessions(s.withColumn("store", F.lit(0)).unionByName(other), M.merge_messages(both(spark, sf)))
    return rows.select("id", "started_at", "last_ts", "is_subagent", "parent_id", "source_tool", "project", "missing_since", "message_count")


SEG2 = "seg2 AS (SELECT * FROM segments UNION ALL SELECT session_id, start_uuid, 'later', summary, tagged_at + 5, 'm1', start_id FROM segments WHERE start_id % 2 = 0)"


def seg2(spark, sf):
    s = D.segments(spark, sf)
    return s.unionByName(s.where("start_id % 2 = 0").withColumns({"topic": F.lit("later"), "tagged_at": F.col("tagged_at") + 5, "origin_machine": F.lit("m1")}))


@query(f", {SEG2} SELECT session_id, start_uuid, topic, origin_machine FROM seg2 QUALIFY row_number() OVER (PARTITION BY session_id, start_uuid ORDER BY origin_machine DESC, tagged_at DESC, topic) = 1")
def merge_topics(spark, sf):
    return M.merge_topics(seg2(spark, sf)).select("session_id", "start_uuid", "topic", "origin_machine")


VER2 = "ver2 AS (SELECT * FROM verdicts UNION ALL SELECT session_id, 'kept', 'agent', 50.0, 'm2' FROM verdicts)"


def ver2(spark, sf):
    v = D.verdicts(spark, sf)
    return v.union(v.select("session_id", F.lit("kept"), F.lit("agent"), F.lit(50.0), F.lit("m2")))


@query(f", {VER2} SELECT session_id, verdict, tagged_at FROM ver2 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY tagged_at DESC, origin_machine DESC, verdict) = 1")
def merge_verdicts(spark, sf):
    return M.merge_verdicts(ver2(spark, sf)).select("session_id", "verdict", "tagged_at")


MARKS = """marks AS (SELECT source_tool AS source, count(DISTINCT session_id) || ':' || count(*) || ':' || max(m.id) || ':t' || any_value(t) || '@' || any_value(a) AS mark FROM messages m JOIN sessions s ON m.session_id = s.id
 JOIN (SELECT source_tool, count(*) AS t, CAST(max(tagged_at) AS BIGINT) AS a FROM segments g JOIN sessions s ON g.session_id = s.id GROUP BY 1) USING (source_tool) GROUP BY 1),
changed AS (SELECT * FROM marks WHERE source <> 'beta')"""


def marks(spark, sf):
    return M.sync_marks(D.messages(spark, sf), D.sessions(spark, sf), D.segments(spark, sf))


def changed(spark, sf):
    m = marks(spark, sf)
    return M.changed_sources(m, m.withColumn("mark", F.when(F.col("source") == "beta", F.col("mark")).otherwise("old")))


@query(f", {MARKS} SELECT source, mark FROM marks")
def sync_marks(spark, sf):
    return marks(spark, sf)


@query(f", {MARKS} SELECT source, mark FROM changed")
def changed_sources(spark, sf):
    return changed(spark, sf)


@query(f", {MARKS} SELECT (SELECT count(*) FROM marks) AS sources, (SELECT count(*) FROM marks) - (SELECT count(*) FROM changed) AS skipped, count(DISTINCT session_id) AS sessions, count(*) AS messages FROM messages m JOIN sessions s ON m.session_id = s.id WHERE source_tool IN (SELECT source FROM changed)")
def sync_stats(spark, sf):
    return M.sync_stats(D.messages(spark, sf), changed(spark, sf), D.sessions(spark, sf), marks(spark, sf))


@query("SELECT 'm' || n AS source FROM range(2, 6) t(n) WHERE 'm' || n NOT IN (SELECT origin_machine FROM sessions)")
def unmerged_sources(spark, sf):
    names = spark.range(2, 6).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("source"))
    return M.unmerged_sources(names, D.sessions(spark, sf).select(F.col("origin_machine").alias("source")).distinct())


@query("SELECT session_id, id, content FROM messages WHERE CAST(session_id AS BIGINT) % 2 = 1 UNION ALL SELECT session_id, id, content FROM second")
def replace_sessions(spark, sf):
    new = D.second_store(spark, sf)
    return M.replace_sessions(D.messages(spark, sf), new, new).select("session_id", "id", "content")


@query("SELECT path FROM listing l WHERE NOT EXISTS (SELECT 1 FROM file_index f WHERE f.path = l.path AND abs(f.mtime - l.mtime) < 0.001 AND f.size = l.size AND f.fp = l.fp)")
def changed_files(spark, sf):
    return M.changed_files(D.listing(spark, sf), D.file_index(spark, sf)).select("path")


@query("SELECT l.path, CASE WHEN f.path IS NULL THEN 'missing' WHEN l.size <> f.size THEN 'size' ELSE 'fingerprint' END AS reason FROM listing l LEFT JOIN (SELECT * FROM file_index WHERE CAST(session_id AS BIGINT) % 5 <> 0) f ON l.path = f.path WHERE (f.path IS NULL OR l.size <> f.size OR l.fp <> f.fp) AND regexp_extract(l.path, '([^/]+)\\.jsonl$', 1) NOT IN (SELECT session_id FROM tombstones)")
def plan_sync(spark, sf):
    replica = D.file_index(spark, sf).where("CAST(session_id AS bigint) % 5 <> 0")
    return M.plan_sync(D.listing(spark, sf), replica, D.tombstones(spark, sf))


ACTIONS = """actions AS (SELECT f.session_id, CASE WHEN t.session_id IS NOT NULL THEN 'prune' WHEN l.path IS NOT NULL AND missing_since IS NOT NULL THEN 'clear' WHEN l.path IS NULL AND missing_since IS NULL THEN 'stamp' ELSE 'none' END AS action
 FROM file_index f LEFT JOIN sessions s ON s.id = f.session_id LEFT JOIN listing l ON l.path = f.path LEFT JOIN tombstones t ON t.session_id = f.session_id)"""


def actions(spark, sf):
    return M.reconcile_retention(D.file_index(spark, sf), D.sessions(spark, sf), D.listing(spark, sf), D.tombstones(spark, sf))


@query(f", {ACTIONS} SELECT session_id, action FROM actions")
def reconcile_retention(spark, sf):
    return actions(spark, sf)


@query(f", {ACTIONS} SELECT id, CASE action WHEN 'stamp' THEN {NOW} WHEN 'clear' THEN NULL ELSE missing_since END AS missing_since FROM sessions JOIN actions ON id = session_id WHERE action <> 'prune'")
def apply_retention(spark, sf):
    return M.apply_retention(D.sessions(spark, sf), actions(spark, sf), NOW)


@query(f", {ACTIONS} SELECT action, count(*) AS n FROM actions GROUP BY action")
def retention_report(spark, sf):
    return M.retention_report(actions(spark, sf))


@query("SELECT id FROM sessions WHERE id NOT IN (SELECT session_id FROM tombstones)")
def prune_tombstoned(spark, sf):
    return M.prune_tombstoned(D.sessions(spark, sf), D.tombstones(spark, sf)).select("id")


@query("SELECT id, project FROM sessions WHERE missing_since IS NOT NULL AND NOT is_subagent AND id NOT IN (SELECT session_id FROM tombstones)")
def retained_sessions(spark, sf):
    return M.retained_sessions(D.sessions(spark, sf), D.tombstones(spark, sf)).select("id", "project")


PLAN = """plan AS (SELECT id AS session_id, CASE WHEN origin_machine <> 'm0' THEN 'foreign_refused' WHEN missing_since IS NOT NULL THEN 'retained' ELSE 'delete' END AS status, message_count * 100 AS size, message_count FROM sessions WHERE message_count <= 4 AND id NOT IN (SELECT session_id FROM tombstones))"""


def plan(spark, sf):
    return M.delete_plan(D.sessions(spark, sf), D.tombstones(spark, sf), D.file_index(spark, sf), "m0", max_messages=4)


@query(f", {PLAN} SELECT session_id, status, size, message_count FROM plan")
def delete_plan(spark, sf):
    return plan(spark, sf)


@query(f", {PLAN} SELECT status, count(*) AS sessions, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(message_count) AS BIGINT) AS messages FROM plan GROUP BY status")
def delete_totals(spark, sf):
    return M.delete_totals(plan(spark, sf))


@query(f", {PLAN} SELECT session_id FROM tombstones UNION SELECT session_id FROM plan WHERE status IN ('delete', 'retained')")
def add_tombstones(spark, sf):
    return M.add_tombstones(D.tombstones(spark, sf), plan(spark, sf))


@query("SELECT path, session_id FROM file_index WHERE session_id IN (SELECT session_id FROM tombstones)")
def propagate_deletes(spark, sf):
    return M.propagate_deletes(D.file_index(spark, sf).drop("session_id"), D.tombstones(spark, sf))


@query("SELECT machine_id, dir, updated_at FROM (SELECT origin_machine AS machine_id, project AS dir, max(last_ts) AS updated_at FROM sessions GROUP BY 1, 2) WHERE machine_id <> 'm0' QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY updated_at DESC, dir) = 1")
def latest_manifest(spark, sf):
    manifests = D.sessions(spark, sf).groupBy(F.col("origin_machine").alias("machine_id"), F.col("project").alias("dir")).agg(F.max("last_ts").alias("updated_at"))
    return M.latest_manifest(manifests, "m0")


@query("SELECT origin_machine AS machine_id, greatest(CASE WHEN origin_machine = 'm2' THEN NULL ELSE max(ts) OVER () + 100000 - last END, 0) AS age, CASE WHEN origin_machine = 'm2' THEN true ELSE max(ts) OVER () + 100000 - last > 86400 END AS stale FROM (SELECT origin_machine, max(last_ts) AS last, max(last_ts) AS ts FROM sessions GROUP BY 1)".replace("greatest(CASE WHEN origin_machine = 'm2' THEN NULL ELSE max(ts) OVER () + 100000 - last END, 0)", "CASE WHEN origin_machine = 'm2' THEN 0 ELSE greatest(max(ts) OVER () + 100000 - last, 0) END"))
def freshness_report(spark, sf):
    s = D.sessions(spark, sf)
    machines = s.groupBy(F.col("origin_machine").alias("machine_id")).agg(F.max("last_ts").alias("l")).select("machine_id", F.when(F.col("machine_id") != "m2", F.col("l")).alias("last_commit"))
    return M.freshness_report(machines, s.agg(F.max("last_ts")).first()[0] + 100000)


@query("SELECT project, count(*) AS live FROM sessions WHERE missing_since IS NULL AND project NOT IN ('p0', 'p3') GROUP BY project")
def orphan_projects(spark, sf):
    s = D.sessions(spark, sf)
    return M.orphan_projects(s, s.where("project IN ('p0', 'p3')"))


@query("SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'dir' END ELSE project END AS project, cwd FROM sessions")
def backfill_scope(spark, sf):
    n = F.col("id").cast("long")
    s = D.sessions(spark, sf).withColumn("project", F.when(n % 3 != 0, F.col("project")))
    folders = s.select("id", F.when(n % 2 == 0, "dir").otherwise("").alias("dir_project"), F.lit("/d").alias("dir_cwd"))
    return M.backfill_scope(s, folders).select("id", "project", "cwd")


@query("SELECT f.session_id, NOT coalesce(l.size <> f.size, false) AS fresh, coalesce(k, 0) >= message_count AS complete FROM file_index f LEFT JOIN listing l ON l.path = f.path JOIN sessions s ON s.id = f.session_id LEFT JOIN (SELECT session_id, count(*) AS k FROM messages WHERE id % 7 <> 0 GROUP BY 1) m ON m.session_id = f.session_id")
def verify_refresh(spark, sf):
    return M.verify_refresh(D.sessions(spark, sf), D.messages(spark, sf).where("id % 7 <> 0"), D.listing(spark, sf), D.file_index(spark, sf))


@query("SELECT (SELECT count(*) FROM file_index) AS vault_sessions, (SELECT count(*) FROM sessions) AS store_sessions")
def assert_no_history_loss(spark, sf):
    return M.assert_no_history_loss(D.file_index(spark, sf), D.sessions(spark, sf))


@query("SELECT id, session_id, 'alpha' AS source_tool FROM messages WHERE id % 2 = 0 UNION ALL SELECT id, session_id, 'beta' FROM second")
def union_sources(spark, sf):
    return M.union_sources({"alpha": D.messages(spark, sf).where("id % 2 = 0"), "beta": D.second_store(spark, sf)}).select("id", "session_id", "source_tool")


# Topics


@query(f"SELECT session_id, id, left(uuid, 8) || ' [' || role || '] ' || left({GEN}, 200) AS line FROM deco WHERE {D.displayable_sql('content')}")
def tag_prep(spark, sf):
    return T.tag_prep(D.messages(spark, sf, True))


@query("SELECT g.session_id, CAST(g.start_id % 1000 AS INTEGER) AS seg_no, CASE WHEN g.start_id % 11 = 0 THEN NULL ELSE g.start_id END AS start_id, CASE WHEN g.start_id % 11 = 0 THEN 'not_found' ELSE 'ok' END AS status FROM segments g")
def resolve_segments(spark, sf):
    s = D.segments(spark, sf).select("session_id", (F.col("start_id") % 1000).cast("int").alias("seg_no"), F.when(F.col("start_id") % 11 == 0, "zzzz").otherwise(F.left("start_uuid", F.lit(10))).alias("start_ref"))
    return T.resolve_segments(s, D.messages(spark, sf)).select("session_id", "seg_no", "start_id", "status")


@query("SELECT g.session_id, start_uuid, (SELECT uuid FROM messages m WHERE m.session_id = g.session_id AND m.id < coalesce(nxt, 1e18) ORDER BY m.id DESC LIMIT 1) AS end_uuid FROM (SELECT *, lead(start_id) OVER (PARTITION BY session_id ORDER BY start_id) AS nxt FROM segments) g")
def build_segments(spark, sf):
    return T.build_segments(D.segments(spark, sf), D.messages(spark, sf))


TOPIC_BM25 = BM25.replace("SELECT id, " + D.tokens_sql("content") + " AS w FROM messages", "SELECT start_id AS id, " + D.tokens_sql("topic || ' ' || summary") + " AS w FROM segments") + """, matches AS (SELECT query_id, g.session_id, start_uuid, topic, project, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, start_id) AS rank FROM scored JOIN segments g ON g.start_id = scored.id LEFT JOIN sessions s ON s.id = g.session_id QUALIFY rank <= 10)"""


def matches(spark, sf):
    return T.match_topics(D.segments(spark, sf).withColumn("seg_id", F.col("start_id")), D.sessions(spark, sf), D.queries(spark))


@query(f", {TOPIC_BM25} SELECT query_id, session_id, start_uuid, topic, project, score, CAST(rank AS INTEGER) AS rank FROM matches")
def match_topics(spark, sf):
    return matches(spark, sf)


@query(f", {TOPIC_BM25}, {ROOTS}, one AS (SELECT m.*, root FROM matches m JOIN roots r ON m.session_id = r.id QUALIFY row_number() OVER (PARTITION BY query_id, root, topic ORDER BY rank) = 1) SELECT query_id, project, root, topic, CAST(row_number() OVER (PARTITION BY query_id, project ORDER BY rank) AS INTEGER) AS place FROM one QUALIFY place <= 5")
def topics_by_project(spark, sf):
    return T.topics_by_project(matches(spark, sf), O.lineage_root(D.sessions(spark, sf)))


@query("SELECT session_id, string_agg(topic, ',' ORDER BY start_id) AS topics FROM segments GROUP BY session_id")
def session_topics(spark, sf):
    return T.session_topics(D.segments(spark, sf))


@query("SELECT session_id FROM segments UNION SELECT session_id FROM verdicts")
def tagged_sessions(spark, sf):
    return T.tagged_sessions(D.segments(spark, sf), D.verdicts(spark, sf))


@query("SELECT session_id, session_id NOT IN (SELECT session_id FROM segments WHERE topic <> '') AS routine FROM verdicts")
def effective_routine(spark, sf):
    return T.effective_routine(D.verdicts(spark, sf), D.segments(spark, sf))


#: Sets of segments by machine and their hashes; the NULs between fields are written in hex, as SQL text can't hold them.
SETS = f"""{SEG2}, sets AS (SELECT session_id, origin_machine, sha1(unhex(string_agg(hex(start_uuid) || '0000' || hex(topic) || '00' || hex(summary || origin_machine), '00' ORDER BY start_uuid, topic, summary))) AS hash FROM seg2 WHERE topic <> '' GROUP BY 1, 2)"""


def tag_sets(spark, sf):
    return T.segment_sets(seg2(spark, sf).withColumn("end_uuid", F.lit(None).cast("string")).withColumn("summary", F.concat("summary", "origin_machine")))


@query(f", {SETS} SELECT session_id, origin_machine, hash FROM sets")
def segment_sets(spark, sf):
    return tag_sets(spark, sf)


@query(f", {SETS} SELECT session_id, max(origin_machine) AS origin_machine, arg_max(hash, origin_machine) AS hash, count(DISTINCT hash) > 1 AS conflict FROM sets GROUP BY session_id")
def resolve_tags(spark, sf):
    return T.resolve_tags(tag_sets(spark, sf))


@query("SELECT session_id, 'm' || (CAST(session_id AS BIGINT) % 3) AS origin_machine FROM (SELECT DISTINCT session_id FROM segments WHERE topic <> '') WHERE CAST(session_id AS BIGINT) % 2 = 0")
def tag_changes(spark, sf):
    resolved = T.resolve_tags(T.segment_sets(D.segments(spark, sf).withColumn("end_uuid", F.lit(None).cast("string"))))
    current = resolved.where("CAST(session_id AS bigint) % 2 = 1")
    return T.tag_changes(resolved, current).select("session_id", "origin_machine")


@query("SELECT session_id, start_uuid, CASE WHEN start_id % 2 = 0 THEN 'new' ELSE topic END AS topic FROM segments")
def upsert_by_key(spark, sf):
    s = D.segments(spark, sf)
    return T.upsert_by_key(s, s.where("start_id % 2 = 0").withColumn("topic", F.lit("new")), ["session_id", "start_uuid"]).select("session_id", "start_uuid", "topic")


@query("""SELECT coalesce(g.session_id, v.session_id) AS session_id, coalesce(n, 0) AS n_segments, topics, starts, summaries, times, verdict, source, v.tagged_at AS verdict_at FROM
(SELECT session_id, count(*) AS n, string_agg(topic, '|' ORDER BY start_uuid) AS topics, string_agg(start_uuid, '|' ORDER BY start_uuid) AS starts, string_agg(summary, '|' ORDER BY start_uuid) AS summaries, CAST(sum(tagged_at) AS DOUBLE) AS times FROM segments GROUP BY 1) g FULL JOIN verdicts v ON v.session_id = g.session_id""")
def export_tags(spark, sf):
    """The documents, read again as JSON."""
    kind = "session_id string, segments array<struct<start_uuid: string, topic: string, summary: string, tagged_at: double>>, verdict struct<verdict: string, source: string, tagged_at: double>"
    d = T.export_tags(D.segments(spark, sf), D.verdicts(spark, sf)).select(F.from_json("document", kind).alias("d")).select("d.*")
    listed = lambda c: F.when(F.col("segments").isNotNull(), F.array_join(F.transform("segments", lambda s: s[c]), "|", ""))
    times = F.when(F.col("segments").isNotNull(), F.aggregate("segments", F.lit(0.0), lambda t, s: t + s["tagged_at"]))
    return d.select("session_id", F.coalesce(F.size("segments"), F.lit(0)).cast("long").alias("n_segments"), listed("topic").alias("topics"), listed("start_uuid").alias("starts"), listed("summary").alias("summaries"), times.alias("times"), "verdict.verdict", "verdict.source", F.col("verdict.tagged_at").alias("verdict_at"))


@query("SELECT session_id, start_uuid, topic FROM segments WHERE CAST(session_id AS BIGINT) % 4 <> 0 UNION ALL SELECT session_id, start_uuid, 'whole' FROM segments WHERE CAST(session_id AS BIGINT) % 4 = 0 AND start_id % 1000 = 0")
def replace_segments(spark, sf):
    s = D.segments(spark, sf)
    new = s.where("CAST(session_id AS bigint) % 4 = 0 AND start_id % 1000 = 0").withColumn("topic", F.lit("whole"))
    return M.replace_sessions(s, s.where("CAST(session_id AS bigint) % 4 = 0"), new).select("session_id", "start_uuid", "topic")
