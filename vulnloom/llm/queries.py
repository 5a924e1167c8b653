"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vulnloom.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    fill_in_middle,
    html_layout,
    language_id,
    ngram_join,
    quality_rules,
    secret_scan,
    shallot,
    token_counts,
    toxicity,
    warc,
)
from vulnloom.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the owners; a source's documents in one language are one of its repositories."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", F.concat_ws("/", F.coalesce("source", F.lit("")), "lang").alias("repo")
    )
    return secret_scan.report(secret_scan.scan(documents))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(table(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measures(table(spark, sf_dir, "documents"))


def op6_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), every_id=True, null_ids=True
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.predictions(documents, language_id.trained(documents))


def op11_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.clustered(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dims=64)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_layout": op6_html_layout,
    "op7_ngram_join": op7_ngram_join,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_shallot": op11_shallot,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_warc": op13_warc,
}
