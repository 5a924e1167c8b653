"""Findings of an external scanner, read from its JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vulnloom.functions.paths import relative_to
from vulnloom.operators.findings import finding_id
from vulnloom.operators.rules import classify, in_scope, scanner_confidence

RESULTS = (
    "results array<struct<check_id:string, path:string, start:struct<line:int>, end:struct<line:int>, "
    "extra:struct<message:string, severity:string, lines:string>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """`repo_id, document` of the scanner outputs at `path`; the file's stem is the repo_id."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1)
    return spark.read.text(path, wholetext=True).select(stem.alias("repo_id"), F.col("value").alias("document"))


def scanner_results(documents: DataFrame) -> DataFrame:
    """One row per result, in order. A malformed document has none; `scanner_rejects` names it."""
    parsed = F.from_json("document", RESULTS)["results"]
    return documents.select("repo_id", F.posexplode(parsed).alias("pos", "r"))


def scanner_rejects(documents: DataFrame) -> DataFrame:
    """`repo_id, path, stage, reason` of the documents without a readable list of results."""
    results = F.from_json("document", RESULTS)["results"]
    reason = F.when(F.try_parse_json("document").isNull(), "not JSON").otherwise("no results")
    return documents.filter(results.isNull()).select(
        "repo_id", F.lit(None).cast("string").alias("path"), F.lit("scanner").alias("stage"), reason.alias("reason")
    )


def scanner_findings(results: DataFrame, repo_root: str = "", target_types: list[str] | None = None) -> DataFrame:
    """Findings in scope, without code context (`operators.findings.with_snippets` adds it)."""
    rule, severity = F.coalesce("r.check_id", F.lit("unknown")), F.coalesce("r.extra.severity", F.lit("WARNING"))
    message = F.coalesce("r.extra.message", F.lit(""))
    start = F.coalesce("r.start.line", F.lit(0))
    path = F.coalesce("r.path", F.lit(""))
    found = results.select(
        "repo_id",
        classify(rule, message).alias("vuln_type"),
        (relative_to(path, F.lit(repo_root)) if repo_root else path).alias("file_path"),
        start.alias("line_start"),
        F.coalesce("r.end.line", start).alias("line_end"),
        F.lit("semgrep").alias("detection_method"),
        scanner_confidence(severity).alias("confidence"),
        F.when(message != "", message)
        .otherwise(F.concat(F.lit("Semgrep rule "), rule, F.lit(" triggered")))
        .alias("message"),
        rule.alias("rule_id"),
        F.create_map(
            F.lit("semgrep_severity"), severity, F.lit("semgrep_rule"), rule,
            F.lit("matched_text"), F.coalesce("r.extra.lines", F.lit("")),
        ).alias("metadata"),
        "pos",
    ).filter(in_scope(F.col("vuln_type"), target_types))
    # The scanner's own order; the empty path sorts its findings before the built-in rules.
    order = F.struct(
        F.lit(0).alias("detector"), F.array().cast("array<string>").alias("path"), F.col("pos").alias("line"),
        F.col("rule_id").alias("rule"),
    )
    return found.withColumns({"id": finding_id(), "seq": order}).drop("pos")
