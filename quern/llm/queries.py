"""The queries of these operators for `__spark_entry__.py`, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import gif_media, html_extract, jaccard_join, lm_scoring, packing, piece_codec, quality_rules, token_counts, toxicity, url_filter
from .common import id_remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 7) == 2)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), toxicity.trainable)
    scored = toxicity.scored(docs, model, ["doc_id"])
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), ["doc_id"])


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = gif_media.digests(gif_media.store(_table(spark, sf_dir, "documents"), ["doc_id"]))
    feature = F.concat(F.lit("frames="), "n_frames", F.lit(" ms="), "delay_ms", F.lit(" grey="), F.concat_ws(",", F.col("histogram").cast("array<string>")))
    media = F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")
    return read.select("doc_id", "n_bytes", F.col("n_pixel_bytes").alias("payload_bytes"), F.col("pixels_sha256").alias("payload_sha256"), "tail_crc32", *media, feature.alias("feature"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), ["doc_id"], keep_ids=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"), ["doc_id"])


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's pieces under dropout, as a digest, and the digest of what they decode to."""
    coded = piece_codec.decode(piece_codec.encode(_table(spark, sf_dir, "documents"), ["doc_id"]))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


_ALL = (op1_url_filter, op2_lm_scoring, op3_html_extraction, op4_toxicity, op5_jaccard_join, op6_token_counts, op7_gif_media, op8_best_fit_packing, op9_quality_rules, op10_piece_codec)
QUERIES = {f.__name__: f for f in _ALL}

_OP1 = r"""
WITH rules(action, rule, h, p) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
cut AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fit AS (SELECT page_id, host, path, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS place
  FROM cut LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE place = 1
"""

ORACLES = {"op1_url_filter": _OP1}
