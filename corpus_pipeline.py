"""A cleaning pipeline over `documents`: each stage reads what the one before has kept.

Toxic documents go, one document of each group of near copies stays, documents with passages of the
benchmark go, credentials that look live are masked, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vulnloom.llm import byte_bpe, decontaminate, ngram_join, secret_scan, toxicity
from vulnloom.llm.common import small_batches, table
from vulnloom.operators.skew import cut as stored


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), null_ids=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked; examples that many sources hold stay as they are."""
    small_batches(spark)
    repo = F.concat_ws("/", F.coalesce("source", F.lit("")), "lang")
    scanned = secret_scan.scan(docs.select("doc_id", "text", "source", repo.alias("repo")))
    masked = secret_scan.redact(docs, scanned, "doc_id", "text")
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)."""
    small_batches(spark)
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_join", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

# A trained classifier decides in the first stage, so SQL cannot state the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
