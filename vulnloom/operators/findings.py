"""Raw findings: identity, code context, configuration filter and de-duplication.

Every findings table has `repo_id, file_path, line_start, line_end, vuln_type, confidence,
detection_method, message, rule_id` and `seq`, an orderable column that gives the order of
discovery (scanner rules before secrets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.config import RuleConfig
from vulnloom.constants import SNIPPET_CONTEXT_LINES
from vulnloom.functions.text import numbered_lines
from vulnloom.operators.blocks import BlockStore, Range
from vulnloom.operators.skew import number_rows

FINDING_KEY = ["repo_id", "file_path", "line_start"]


def finding_id() -> Column:
    """Reproducible id from what was found where."""
    named = F.concat_ws(
        "\u0000", "repo_id", "file_path", F.col("line_start").cast("string"), "detection_method", "rule_id"
    )
    return F.substring(F.sha2(named, 256), 1, 24)


def line_snippets(targets: DataFrame, files: DataFrame, context: int = SNIPPET_CONTEXT_LINES) -> DataFrame:
    """`code_snippet` for each distinct (repo_id, file_path, line_start) of `targets`."""
    at = targets.select(*FINDING_KEY, F.col("line_start").alias("line_end"))
    shown = BlockStore(at, files).spans(at, Range(before=context + 1, after=context, short=0))
    return shown.select(*FINDING_KEY, F.array_join(numbered_lines("lines", F.col("start")), "\n").alias("code_snippet"))


def with_snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with `code_snippet`; empty when the file is missing."""
    shown = line_snippets(findings, files)
    joined = findings.drop("code_snippet").join(shown, FINDING_KEY, "left")
    return joined.withColumn("code_snippet", F.coalesce("code_snippet", F.lit("")))


def marked_findings(findings: DataFrame, config: RuleConfig) -> DataFrame:
    """Findings with `drop_reason`: disabled check first, then excluded path, else null."""
    reason = F.when(~config.enabled(F.col("vuln_type")), "disabled_check").when(
        config.excludes(F.col("file_path")), "excluded_path"
    )
    return findings.withColumn("drop_reason", reason)


def filter_findings(findings: DataFrame, config: RuleConfig) -> DataFrame:
    return marked_findings(findings, config).filter(F.col("drop_reason").isNull()).drop("drop_reason")


def drop_counts(findings: DataFrame, config: RuleConfig) -> DataFrame:
    """Findings per repository dropped by each rule of the configuration."""
    reason = F.col("drop_reason")
    return marked_findings(findings, config).groupBy("repo_id").agg(
        F.count_if(reason == "disabled_check").alias("disabled_checks"),
        F.count_if(reason == "excluded_path").alias("excluded_paths"),
        F.count_if(reason.isNull()).alias("kept"),
    )


def dedup_findings(findings: DataFrame) -> DataFrame:
    """The most confident finding of each (repo_id, file_path, line_start).

    Ties go to the first discovered; `first_seq` is where the line first appeared. An aggregate
    rather than a window: each task reduces its own rows first, so a line with a great many
    findings costs one row per task in the shuffle.
    """
    rest = [c for c in findings.columns if c not in FINDING_KEY]
    best = F.min_by(F.struct(*rest), F.struct((-F.col("confidence")).alias("c"), F.col("seq").alias("s")))
    grouped = findings.groupBy(*FINDING_KEY).agg(best.alias("_best"), F.min("seq").alias("first_seq"))
    return grouped.select(*FINDING_KEY, *[F.col(f"_best.{c}").alias(c) for c in rest], "first_seq")


def numbered_findings(findings: DataFrame) -> DataFrame:
    """De-duplicated findings with `seq` replaced by their place in the repository, from 1."""
    return number_rows(findings.drop("seq"), ["repo_id"], ["first_seq"], "seq").drop("first_seq")


def counts_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id", "vuln_type").agg(F.count("*").alias("findings"))
