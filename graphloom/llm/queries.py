"""The registered queries of this subpackage, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bestfit, embedding_dedup, html, langid, lexical, minhash, mining, packing, sampling, suffix, toxicity, warc
from .common import Stage, shared_dir, table


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents"))
    model = toxicity.fit(docs, spark.read.parquet(table(sf_dir, "labels")))
    scored = toxicity.toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        F.col("toxicity_score").alias("score"),
        F.col("toxicity_label").alias("predicted"),
    )


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(table(sf_dir, "documents")))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(spark.read.parquet(table(sf_dir, "documents")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.sample(spark.read.parquet(table(sf_dir, "documents")))
    return drawn.select(*(c for c in drawn.columns if c != "ids"), "ids")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(table(sf_dir, "embeddings")))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(table(sf_dir, "pages")))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(table(sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(table(sf_dir, "documents")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.new_path(shared_dir(spark))
    warc.write(spark.read.parquet(table(sf_dir, "pages")), path)
    captures = warc.assemble(warc.read(spark, path, blocks=False)).select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), "response.*",
    )
    captures = Stage(spark, "captures").keep(captures.select("page_id", "record_id", "type", "refers_to", "payload_digest", "payload_bytes", "payload_sha256"))
    own = captures.where("type = 'response'").select("page_id", "payload_bytes", F.col("payload_sha256").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    held = captures.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"), F.col("payload_bytes").alias("size"), F.col("payload_sha256").alias("sha"))
    again = captures.where("type = 'revisit'").join(held, "refers_to", "left")
    same = F.coalesce(F.lower(F.substring_index("payload_digest", ":", -1)) == F.col("sha"), F.lit(False))
    digest = F.when(same, F.col("sha")).otherwise(F.raise_error(F.concat(F.lit("no such payload as revisited by "), F.col("record_id"))).cast("string"))
    again = again.select("page_id", F.col("size").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), F.col("first").alias("refers_to"))
    return own.unionByName(again)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = langid.of_pages(spark.read.parquet(table(sf_dir, "pages")))
    return langid.identify(pages, langid.fit(pages), ["page_id", "url"])


def op11_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(spark.read.parquet(table(sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, label=moved)


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(spark.read.parquet(table(sf_dir, "documents")))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(spark.read.parquet(table(sf_dir, "documents")), spark.read.parquet(table(sf_dir, "benchmark")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_suffix": op2_suffix,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_html": op6_html,
        "op7_packing": op7_packing,
        "op8_ann": op8_ann,
        "op9_warc": op9_warc,
        "op10_langid": op10_langid,
        "op11_mining": op11_mining,
        "op12_bestfit": op12_bestfit,
        "op13_lexical": op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": OP1_SQL,
        "op4_embedding_dedup": OP4_SQL,
        "op9_warc": OP9_SQL,
        "op11_mining": OP11_SQL,
        "op13_lexical": OP13_SQL,
    }


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), i AS (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS k FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[k:k + 4], ' ') END AS shingle FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, any_value(coalesce(n.n, 0))::BIGINT AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.vec_id, any_value(coalesce(n.n, 0))::BIGINT AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept
FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id
"""


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 3
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL
), q AS (
  SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), r AS (SELECT item, item_id, term, count(*) AS times FROM q GROUP BY ALL),
n AS (SELECT count(*)::BIGINT AS docs, sum(len(words))::BIGINT AS total FROM d WHERE len(words) > 0),
t AS (SELECT row, doc_id, len(words)::BIGINT AS size, unnest(words) AS term FROM d),
tf AS (SELECT row, doc_id, size, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM r) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, n GROUP BY term),
s AS (
  SELECT item, item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * docs) // total))))::BIGINT AS score
  FROM r JOIN tf USING (term) JOIN w USING (term), n GROUP BY item, item_id, row, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""
