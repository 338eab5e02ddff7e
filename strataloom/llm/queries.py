"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, line_dedup, mjpeg, ngram_join, packing, sharding, tokens, toxicity, url_reputation, vafile
from .common import prepare, read_table


def op1_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.clean(docs)


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is the quality label of the document with its id."""
    outcomes = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.judge_pages(read_table(spark, sf_dir, "pages"), outcomes)


def op3_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op4_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokens.byte_encoder)


def op5_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op6_motion_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    stored = mjpeg.store(read_table(spark, sf_dir, "documents"))
    return mjpeg.digest(mjpeg.read(stored))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.round_trip_digest(read_table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op8_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    vectors = read_table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, lambda i: i % 100 == 0)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.similarity_classes(read_table(spark, sf_dir, "documents"))


def op10_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fuzzy_line_dedup": op1_fuzzy_line_dedup,
        "op2_host_reputation": op2_host_reputation,
        "op3_convolutional_toxicity": op3_convolutional_toxicity,
        "op4_grouping_genetic_packing": op4_grouping_genetic_packing,
        "op5_two_pass_shuffle": op5_two_pass_shuffle,
        "op6_motion_jpeg_media": op6_motion_jpeg_media,
        "op7_prefix_bpe": op7_prefix_bpe,
        "op8_va_file_top_k": op8_va_file_top_k,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_hierarchical_language_id": op10_hierarchical_language_id,
    }


OP2_SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:\d*)?\.?$', '') AS bare FROM p),
lab AS (SELECT doc_id AS page_id, count(*) AS n, sum(quality) AS s FROM labels WHERE quality IS NOT NULL GROUP BY 1),
h AS (SELECT bare, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(s), 0)::DOUBLE AS s FROM k LEFT JOIN lab USING (page_id) GROUP BY 1),
hd AS (SELECT *,
    list_aggregate(list_slice(string_split(bare, '.'), greatest(len(string_split(bare, '.')) - 1, 1), 1000), 'string_agg', '.') AS two,
    bare LIKE '%:%' OR regexp_matches(bare, '^[\d.]+$') AS plain FROM h),
hs AS (SELECT *, CASE WHEN two IN ('co.uk','org.uk','ac.uk','gov.uk','com.au','net.au','org.au','co.jp','ne.jp','or.jp','com.br','co.nz','co.in','com.cn','com.mx','co.za','com.tr','co.kr') THEN two
    WHEN plain THEN bare ELSE string_split(bare, '.')[-1] END AS suffix FROM hd),
hk AS (SELECT *, CASE WHEN plain THEN bare ELSE list_aggregate(list_slice(string_split(bare, '.'), greatest(len(string_split(bare, '.')) - len(string_split(suffix, '.')), 1), 1000), 'string_agg', '.') END AS domain FROM hs),
top AS (SELECT (sum(s) + 1) / (sum(n) + 2) AS m FROM hk),
s0 AS (SELECT suffix, sum(n) AS n, sum(s) AS s, any_value(m) AS m FROM hk, top GROUP BY suffix),
ks AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 1.0 ELSE 1 / least(0.5, greatest(1e-4, (sum(n * power(s / n - m, 2) / greatest(m * (1 - m), 1e-6)) - count(*)) / (sum(n) - count(*)))) - 1 END AS k FROM s0 WHERE n > 0),
s1 AS (SELECT suffix, (s + k * m) / (n + k) AS m FROM s0, ks),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s, any_value(m) AS m FROM hk JOIN s1 USING (suffix) GROUP BY domain, suffix),
kd AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 1.0 ELSE 1 / least(0.5, greatest(1e-4, (sum(n * power(s / n - m, 2) / greatest(m * (1 - m), 1e-6)) - count(*)) / (sum(n) - count(*)))) - 1 END AS k FROM d0 WHERE n > 0),
d1 AS (SELECT domain, suffix, (s + k * m) / (n + k) AS m FROM d0, kd),
h0 AS (SELECT bare, n, s, m FROM hk JOIN d1 USING (domain, suffix)),
kh AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 1.0 ELSE 1 / least(0.5, greatest(1e-4, (sum(n * power(s / n - m, 2) / greatest(m * (1 - m), 1e-6)) - count(*)) / (sum(n) - count(*)))) - 1 END AS k FROM h0 WHERE n > 0),
post AS (SELECT bare, n, (s + k * m) / (n + k) AS mean, n + k AS size FROM h0, kh),
j AS (SELECT k.*, n, mean, greatest(0.0, mean - 1.6448536269514722 * sqrt(mean * (1 - mean) / (size + 1))) AS lower,
  CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM k JOIN post USING (bare))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower >= 0.5 THEN 'allow' ELSE 'block' END AS verdict,
  n::BIGINT AS n_labelled, round(mean, 6) AS good_rate, round(lower, 6) AS good_lower
FROM j
"""

OP8_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_host_reputation": OP2_SQL, "op8_va_file_top_k": OP8_SQL}
