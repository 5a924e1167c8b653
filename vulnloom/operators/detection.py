"""Rule and secret detection in one pass over file contents, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.config import RuleConfig
from vulnloom.constants import SNIPPET_CONTEXT_LINES
from vulnloom.functions import paths
from vulnloom.functions.text import let, snippet, split_lines
from vulnloom.operators import rules as rule_ops, secrets as secret_ops
from vulnloom.operators.findings import finding_id
from vulnloom.operators.rules import RULES, Rule
from vulnloom.operators.secrets import SECRET_PATTERNS, SecretPattern

RAW_FINDING = [
    "repo_id", "id", "vuln_type", "file_path", "line_start", "line_end", "code_snippet", "detection_method",
    "confidence", "message", "rule_id", "metadata", "seq",
]


def _candidate_lines(content: Column, candidate) -> Column:
    """array<struct(line, text, code_snippet, rule_scope, secret_scope)> of the lines worth a closer look."""

    def hits(lines: Column, context_lines: Column) -> Column:
        numbered = F.transform(lines, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
        return F.transform(
            F.filter(numbered, lambda x: candidate(x["text"])),
            lambda x: F.struct(
                x["line"].alias("line"),
                x["text"].alias("text"),
                snippet(context_lines, x["line"], SNIPPET_CONTEXT_LINES).alias("code_snippet"),
                F.col("rule_scope").alias("rule_scope"),
                F.col("secret_scope").alias("secret_scope"),
            ),
        )

    return let(
        F.struct(F.split(content, "\n").alias("lines"), split_lines(content).alias("context")),
        lambda s: hits(s["lines"], s["context"]),
    )


def detect(
    files: DataFrame,
    config: RuleConfig | None = None,
    rules: list[Rule] = RULES,
    secret_patterns: list[SecretPattern] = SECRET_PATTERNS,
    target_types: list[str] | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Raw findings of the injection rules and the secret patterns.

    Rules look at source files (up to `max_bytes`, if given; `skipped_files` names the others),
    secrets at text files outside skipped directories that are not tests. With `config`, excluded files and disabled checks
    are left out before any content is read. Each file is read once, split into lines only if
    a cheap test says it may hold a finding, and its findings carry their context with them.
    """
    if config is not None:
        files = files.filter(~config.excludes(F.col("relative_path")))
    lines = candidate_lines(rules, secret_patterns).alias("lines")
    narrow = scoped(files, rules, secret_patterns, max_bytes).select("repo_id", "relative_path", lines)
    return from_lines(narrow, config, rules, secret_patterns, target_types)


def scoped(
    files: DataFrame,
    rules: list[Rule] = RULES,
    secret_patterns: list[SecretPattern] = SECRET_PATTERNS,
    max_bytes: int | None = None,
) -> DataFrame:
    """`files` with `language`, `rule_scope` and `secret_scope`, which are worked out once per file."""
    path, lang = F.col("relative_path"), F.col("language")
    rule_scope = lang.isNotNull() if rules else F.lit(False)
    if max_bytes is not None:
        rule_scope = rule_scope & (F.col("size_bytes") <= max_bytes)
    secret_scope = (
        (paths.in_secret_scope(path) | (lang.isNotNull() & ~paths.in_skipped_directory(path)))
        & ~paths.is_test_file(path)
        if secret_patterns
        else F.lit(False)
    )
    rows = files.withColumn("language", paths.language(path))
    return rows.withColumns({"rule_scope": F.coalesce(rule_scope, F.lit(False)), "secret_scope": secret_scope})


def candidate_lines(rules: list[Rule] = RULES, secret_patterns: list[SecretPattern] = SECRET_PATTERNS) -> Column:
    """The lines of a row of `scoped` that may hold a finding, with their context; null if it has none."""
    lang, content = F.col("language"), F.col("content")

    def candidate(text: Column) -> Column:
        by_rule = F.col("rule_scope") & rule_ops.hint(rules, lang, text)
        return F.coalesce(by_rule, F.lit(False)) | (F.col("secret_scope") & secret_ops.hint(secret_patterns, text))

    in_scope = F.col("rule_scope") | F.col("secret_scope")
    return F.when(in_scope & candidate(content), _candidate_lines(content, candidate))


def from_lines(
    files: DataFrame,
    config: RuleConfig | None = None,
    rules: list[Rule] = RULES,
    secret_patterns: list[SecretPattern] = SECRET_PATTERNS,
    target_types: list[str] | None = None,
) -> DataFrame:
    """Raw findings from `repo_id, relative_path` and the `lines` of `candidate_lines`."""
    language = paths.language(F.col("file_path"))
    lines = files.select("repo_id", F.col("relative_path").alias("file_path"), F.explode("lines").alias("at"))
    text = F.col("at.text")
    by_rule = [F.when(F.col("at.rule_scope"), m) for m in rule_ops.rule_matches(rules, language, text)]
    by_pattern = [F.when(F.col("at.secret_scope"), m) for m in secret_ops.secret_matches(secret_patterns, text)]
    found = lines.select(
        "repo_id",
        "file_path",
        F.col("at.line").alias("line_start"),
        F.col("at.line").alias("line_end"),
        F.col("at.code_snippet").alias("code_snippet"),
        F.explode(F.array_compact(F.array(*by_rule, *by_pattern))).alias("f"),
    )
    found = found.select(
        "repo_id", "file_path", "line_start", "line_end", "code_snippet",
        F.when(F.col("f.detector") == 1, "hardcoded_secret")
        .otherwise(rule_ops.classify(F.col("f.rule_id"), F.col("f.message")))
        .alias("vuln_type"),
        "f.detection_method", "f.confidence", "f.message", "f.rule_id", "f.metadata",
        F.struct(
            F.col("f.detector").alias("detector"),
            paths.parts(F.col("file_path")).alias("path"),
            F.col("line_start").alias("line"),
            F.col("f.rule_id").alias("rule"),
        ).alias("seq"),
    ).filter(rule_ops.in_scope(F.col("vuln_type"), target_types))
    if config is not None:
        found = found.filter(config.enabled(F.col("vuln_type")))
    return found.withColumn("id", finding_id()).select(*RAW_FINDING)


def skipped_files(files: DataFrame, max_bytes: int) -> DataFrame:
    """`repo_id, path, stage, reason` of the source files that `detect(max_bytes=...)` leaves out of the rules."""
    over = paths.language(F.col("relative_path")).isNotNull() & (F.col("size_bytes") > max_bytes)
    reason = F.format_string("larger than %d bytes", F.lit(max_bytes))
    return files.filter(over).select(
        "repo_id", F.col("relative_path").alias("path"), F.lit("detect").alias("stage"), reason.alias("reason")
    )
