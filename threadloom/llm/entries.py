"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, clustering, html_text, mixing, near_dedup, pii, quality_rules, sentence_spans, sentencepiece_codec, spelling, token_planes, topk, toxicity
from .common import documents, scratch

#: Where the public tokenizer files are; a parameter, as they are never copied.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "")


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf_dir)).select("doc_id", "class_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs))


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "planes")
    token_planes.write_corpus(documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"))
    return token_planes.corpus_digest(spark, path)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, vectors.where("id % 100 = 0"), 10)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.clean(documents(spark, sf_dir)).select("doc_id", "text", "n_sentences", "n_removed", "first_ids")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(clustering.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_planes, op2_exact_top_k, op3_mixing, op4_sentencepiece, op5_sentence_spans, op6_html_text, op8_quality_rules, op7_pii, op9_near_dedup, op10_quality_classifier, op11_toxicity, op12_spelling_variants, op13_simplex_clusters)}


#: Vectors as integers, all pairs of a query and another vector, and the ten best.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.vec) = len(c.vec)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


#: Bitwise crc32 of <doc_id>:<run>, words by count, neighbours by equal texts with one code point
#: left out, and forms followed one by one.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), each AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE len(run) >= 7 GROUP BY ALL
), bytes AS (
  SELECT run, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (CAST(unicode(x) AS BIGINT) >> 6), 128 + (CAST(unicode(x) AS BIGINT) & 63)] END)) AS b FROM each
), hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda h, x: xor(h >> 8, t[1 + (xor(h, x) & 255)])), 4294967295) AS h FROM bytes, crc
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, c FROM hashed
), w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE len(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), k AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w
), parts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM k
), links AS (
  SELECT a.word AS word, b.word AS near, b.n AS m FROM parts a JOIN parts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM parts a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM parts a JOIN w b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM links GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n,
         CASE WHEN b.m >= 10 * w.n THEN (SELECT min(near) FROM links l WHERE l.word = w.word AND l.m = b.m) END AS form
  FROM w LEFT JOIN best b ON b.word = w.word
), walk AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT k.word, f.form, k.step + 1 FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NOT NULL
), ends AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""


def _round_sql(i: int) -> str:
    """The i-th round: d has every vector's nearest centroid of c{i}, c{i + 1} the centroids after it."""
    return f"""
, d{i} AS (
  SELECT id, min_by(struct_pack(k := c.k, d := list_sum(list_transform(list_zip(v.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))),
    struct_pack(d := list_sum(list_transform(list_zip(v.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), k := c.k)) AS m
  FROM v, c{i} c GROUP BY id
), s{i} AS (
  SELECT k, list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) ORDER BY j) AS vec FROM (
    SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT d.m.k AS k, unnest(v.vec) AS x, unnest(range(1, 65)) AS j FROM d{i} d JOIN v ON v.id = d.id) GROUP BY k, j) GROUP BY k
), c{i + 1} AS (SELECT c.k, coalesce(s.vec, c.vec) AS vec FROM c{i} c LEFT JOIN s{i} s ON s.k = c.k)"""


#: Plain k-means in integers: every vector against every centroid, three rounds written out.
OP13_SQL = (
    """
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS vec FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, vec) - 1 AS k, vec FROM (SELECT sha256('1:' || vec_id) AS h, vec FROM v WHERE vec_id IS NOT NULL ORDER BY h, vec LIMIT 16)
)"""
    + "".join(_round_sql(i) for i in range(4))
    + """
SELECT v.vec_id, CAST(d.m.k AS INTEGER) AS cluster, CAST(d.m.d AS BIGINT) AS distance, CAST(sum(d.m.d) OVER (PARTITION BY d.m.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.vec, ',')) AS centroid_sha256
FROM d3 d JOIN v ON v.id = d.id JOIN c3 c ON c.k = d.m.k
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL, "op12_spelling_variants": OP12_SQL, "op13_simplex_clusters": OP13_SQL}
