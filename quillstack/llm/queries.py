"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import ball_kmeans, byte_bpe, divergence, exact_dedup, licenses, lm_scoring, mixing, packing, quality, secrets, sharding, simhash, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_topk(spark, sf_dir):
    return topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op3_stratified_sharding(spark, sf_dir):
    rows = sharding.interleaved_shards(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mixed_words(mixing.plan_mix(table(spark, sf_dir, "documents")))


def op7_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encoded_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_simhash_dedup(spark, sf_dir):
    rows = simhash.near_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lm_scoring(spark, sf_dir):
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_ball_kmeans(spark, sf_dir):
    return ball_kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_quality_classifier, op2_exact_topk, op3_stratified_sharding, op4_exact_dedup, op5_license_scan, op6_source_mixing, op7_secret_scan, op8_byte_bpe, op9_simhash_dedup, op10_lm_scoring,
    op11_source_divergence, op12_best_fit_packing, op13_ball_kmeans,
)
QUERIES = {f.__name__: f for f in _ALL}
