"""A scan of many repositories at once.

Contents are read once: `extracted` writes down a narrow row per file with all that the stages of
detection want, and manifests, structure rows, dependencies and findings come from these rows.
Digests and patches fetch the texts of single files by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from vulnloom.config import RuleConfig
from vulnloom.functions import paths, text
from vulnloom.operators import (
    dependencies as dependency_ops,
    detection,
    digest as digest_ops,
    findings as finding_ops,
    manifest as manifest_ops,
    patches as patch_ops,
    repo_config,
    report,
    scope,
    structure,
    verdicts,
)
from vulnloom.operators.skew import cut, fits_broadcast
from vulnloom.sources import scanner
from vulnloom.sources.files import unreadable


@dataclass(frozen=True)
class Detection:
    """Stages up to detection."""

    files: DataFrame
    manifest: DataFrame
    summary: DataFrame
    functions: DataFrame
    imports: DataFrame
    calls: DataFrame
    dependencies: DataFrame
    findings: DataFrame


@dataclass(frozen=True)
class Verdicts:
    """Stages from analysis to patches."""

    enriched: DataFrame
    validated: DataFrame
    confirmed: DataFrame
    patches: DataFrame
    results: DataFrame


# The columns of `manifest.measured`.
MEASURED = ["repo_id", "relative_path", "language", "risk_level", "line_count", "estimated_tokens", "size_bytes"]


def extracted(
    files: DataFrame,
    config: RuleConfig,
    changed: DataFrame | None = None,
    repo_configs: DataFrame | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """All that a scan wants of each file, in one pass over the contents, written down as a narrow row.

    Line counts, functions, imports, calls, declared dependencies, and the lines that may hold a
    finding. Of files that did not change, and of excluded ones, the parts nobody asks for are not
    looked at, as far as the tables that say so are small enough to be sent to all tasks; what they
    leave over is filtered afterwards.
    """
    path, content, lang = F.col("relative_path"), F.col("content"), F.col("language")
    scanned, excluded = F.lit(True), config.excludes(path)
    rows = files.select("repo_id", "relative_path", "content", "size_bytes")
    if changed is not None and fits_broadcast(changed):
        rows = rows.join(F.broadcast(changed.withColumn("_changed", F.lit(True))), ["repo_id", "relative_path"], "left")
        scanned = F.col("_changed").isNotNull()
    if repo_configs is not None:
        excluded = F.lit(False)
        if fits_broadcast(repo_configs):
            rows = rows.join(F.broadcast(repo_configs), "repo_id", "left")
            excluded = repo_config.excluded_by(path, F.col("config"), config)
    # What depends on the path alone becomes a column first, so that it is not repeated for each line.
    rows = detection.scoped(rows, max_bytes=max_bytes).withColumns(
        {"skipped": paths.in_skipped_directory(path), "risk_level": paths.risk_level(path), "_looked_at": scanned, "_excluded": excluded}
    )
    rows = rows.withColumn("_source", lang.isNotNull() & ~F.col("skipped"))
    wanted = F.col("_source") & F.col("_looked_at")
    line_count = text.manifest_line_count(content)
    return cut(
        rows.select(
            "repo_id",
            "relative_path",
            "language",
            "risk_level",
            "size_bytes",
            "skipped",
            F.when(F.col("_source"), line_count).alias("line_count"),
            F.when(F.col("_source"), text.manifest_tokens(line_count)).alias("estimated_tokens"),
            F.when(wanted, structure.function_matches(content, lang)).alias("functions"),
            F.when(wanted, structure.import_matches(content, lang)).alias("imports"),
            F.when(wanted, structure.call_matches(content, lang)).alias("calls"),
            dependency_ops.declared_in(path, content).alias("declared"),
            F.when(F.col("_looked_at") & ~F.col("_excluded"), detection.candidate_lines()).alias("lines"),
        )
    )


def detect(
    files: DataFrame,
    config: RuleConfig | None = None,
    changed_files: DataFrame | None = None,
    scanner_findings: DataFrame | None = None,
    repo_configs: DataFrame | None = None,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> Detection:
    """Manifest, structure, dependencies and de-duplicated findings.

    With `changed_files` the scan is limited to the changes: the manifest after its file limit,
    the rules and the secret patterns to every changed file. `scanner_findings` are results of
    an external scanner; they come before our own. `repo_configs` (`operators.repo_config`) gives
    repositories a configuration of their own in place of `config`. `max_files` and `max_bytes` are
    limits on request; `operators.manifest.limit_counts` and `rejects` tell what they leave out.
    """
    config = config or RuleConfig()
    changed = None if changed_files is None else cut(scope.changed_paths(changed_files))
    if repo_configs is not None:
        repo_configs = cut(repo_configs)
    read = extracted(files, config, changed, repo_configs, max_bytes)
    in_walk = read.filter(F.col("language").isNotNull() & ~F.col("skipped"))
    manifest = cut(manifest_ops.manifest(files, max_files, in_walk.select(*MEASURED)))
    summary = manifest_ops.manifest_summary(files, manifest)
    if changed is not None:
        manifest = cut(scope.in_diff(manifest, changed))
        summary = manifest_ops.scoped_summary(summary, manifest)
        if scanner_findings is not None:
            scanner_findings = scope.in_diff(scanner_findings, changed, "file_path")
    sources = in_walk.withColumnRenamed("relative_path", "file_path")
    found = detection.from_lines(read, config if repo_configs is None else None)
    if changed is not None:
        found = scope.in_diff(found, changed, "file_path")
    if scanner_findings is not None:
        imported = finding_ops.with_snippets(scanner_findings, files)
        found = imported.select(*detection.RAW_FINDING).unionByName(found)
    if repo_configs is not None:
        found = repo_config.filter_findings(found, repo_configs, config)
    elif scanner_findings is not None:
        found = finding_ops.filter_findings(found, config)
    unique = cut(finding_ops.dedup_findings(found))
    return Detection(
        files=files,
        manifest=manifest,
        summary=summary,
        functions=structure.in_manifest(structure.functions(sources), manifest),
        imports=structure.in_manifest(structure.imports(sources), manifest),
        calls=structure.in_manifest(structure.dangerous_calls(sources), manifest),
        dependencies=dependency_ops.dependencies(read),
        findings=finding_ops.numbered_findings(unique),
    )


def digest(found: Detection, max_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections kept, all planned sections); all are kept unless a budget is passed."""
    repos = found.summary.select("repo_id")
    return digest_ops.build_digest(repos, found.manifest, found.files, found.functions, found.findings, max_tokens)


def judge(
    found: Detection,
    repos: DataFrame,
    responses: DataFrame,
    config: RuleConfig | None = None,
    repo_configs: DataFrame | None = None,
    apply_confidence_threshold: bool = False,
) -> Verdicts:
    """Verdicts, patches and the per-repository result from model replies."""
    config = config or RuleConfig()
    enriched = verdicts.apply_analysis(found.findings, responses)
    if repo_configs is None:
        enriched = verdicts.severity_gate(enriched, config)
    else:
        enriched = repo_config.severity_gate(enriched, repo_configs, config)
    threshold = config.confidence_threshold if apply_confidence_threshold else None
    validated = cut(verdicts.apply_reviews(enriched, responses, threshold))
    confirmed = verdicts.confirmed(validated)
    patches = cut(patch_ops.assemble_patches(confirmed, responses, found.files))
    results = report.scan_results(repos, found.summary, found.findings, confirmed, patches, responses=responses)
    return Verdicts(enriched, validated, confirmed, patches, results)


def rejects(
    files: DataFrame, scanner_documents: DataFrame | None = None, max_bytes: int | None = None
) -> DataFrame:
    """`repo_id, path, stage, reason` of all input that a scan cannot use or was told to leave out.

    `files` may have the `error` column of `sources.files.read_with_errors`.
    """
    out = repo_config.config_rejects(files)
    if "error" in files.columns:
        out = out.unionByName(unreadable(files))
    if scanner_documents is not None:
        out = out.unionByName(scanner.scanner_rejects(scanner_documents))
    if max_bytes is not None:
        out = out.unionByName(detection.skipped_files(files, max_bytes))
    return out
