"""The `responses` table of model replies, from raw API bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BODY = (
    "content array<struct<type:string, text:string>>, usage struct<input_tokens:bigint, output_tokens:bigint>, model string"
)


def responses(raw: DataFrame) -> DataFrame:
    """From `repo_id, finding_id, stage, body, error, latency_ms`; a row with an error failed.

    The text blocks of a body are joined by newlines; token counts default to 0.
    """
    parsed = raw.withColumn("_b", F.from_json("body", BODY))
    ok = F.col("error").isNull()
    texts = F.transform(F.filter("_b.content", lambda x: x["type"] == "text"), lambda x: x["text"])

    def when_ok(value: Column, default: Column) -> Column:
        return F.when(ok, F.coalesce(value, default)).otherwise(default)

    return parsed.select(
        "repo_id", "finding_id", "stage",
        when_ok(F.array_join(texts, "\n"), F.lit("")).alias("content"),
        ok.alias("success"),
        "error",
        when_ok(F.col("_b.usage.input_tokens"), F.lit(0)).alias("input_tokens"),
        when_ok(F.col("_b.usage.output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce("_b.model", F.lit("")).alias("model"),
        "latency_ms",
    )
