"""A corpus pipeline of five stages over ``documents``: filter, deduplicate twice, mix, encode.

Stages take documents with any further columns, whatever their names, and an empty table gives an empty
one. What each does with nulls, ties, repeated rows, empty and very long texts is that of the operator
it calls; the docstrings say it in short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import byte_bpe, exact_dedup, mixing, quality, simhash
from quillstack.llm.common import materialize


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored as the empty one, long ones whole; rows that repeat and rows without doc_id are judged each."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id; null and empty texts are copies, and of ties the largest row stays."""
    return exact_dedup.distinct_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the least doc_id; texts without words are one component, and rows without a doc_id stay."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its schedule; a document taken twice is two rows, null and wordless texts go, a null source is one of its own."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, a row for each row of the mix; a null text has no tokens."""
    import public_tokenizers

    return byte_bpe.encoded_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", accept_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The classifier and XXH64 can't be written in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
