"""Which files a scan looks at: diff scoping, exclusions, secret-scan scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vulnloom.config import RuleConfig
from vulnloom.functions import paths

# Added, copied, modified, renamed; deletions leave nothing to scan.
SCANNED_CHANGES = ["A", "C", "M", "R"]


def changed_paths(changed_files: DataFrame) -> DataFrame:
    """Distinct (repo_id, relative_path) of the changes that leave a file behind."""
    path = paths.normalize_path(F.trim("path"))
    return (
        changed_files.filter(F.col("change_type").isin(SCANNED_CHANGES) & (F.trim("path") != ""))
        .select("repo_id", path.alias("relative_path"))
        .distinct()
    )


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed-file table from two snapshots of `files`, by content hash."""
    digest = F.sha2("content", 256)
    old = before.select("repo_id", F.col("relative_path").alias("path"), digest.alias("old"))
    new = after.select("repo_id", F.col("relative_path").alias("path"), digest.alias("new"))
    change = (
        F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "M")
    )
    return (
        old.join(new, ["repo_id", "path"], "full")
        .select("repo_id", "path", change.alias("change_type"))
        .filter(F.col("change_type").isNotNull())
    )


def in_diff(rows: DataFrame, changed: DataFrame, path: str = "relative_path") -> DataFrame:
    """Rows of any table keyed by repository and file whose file changed."""
    wanted = changed.withColumnRenamed("relative_path", path) if path != "relative_path" else changed
    return rows.join(wanted, ["repo_id", path], "left_semi")


def not_excluded(files: DataFrame, config: RuleConfig) -> DataFrame:
    return files.filter(~config.excludes(F.col("relative_path")))


def scan_targets(files: DataFrame, changed: DataFrame, config: RuleConfig) -> DataFrame:
    """Changed files that exist and are not excluded, in any language."""
    return in_diff(not_excluded(files, config), changed)


def secret_targets(files: DataFrame, manifest_files: DataFrame, config: RuleConfig) -> DataFrame:
    """Files to scan for secrets: the text files in scope, plus manifest files they miss."""
    by_name = not_excluded(files, config).filter(paths.in_secret_scope(F.col("relative_path")))
    by_name = by_name.select("repo_id", "relative_path")
    from_manifest = not_excluded(manifest_files, config).select("repo_id", "relative_path")
    missed = from_manifest.join(by_name, ["repo_id", "relative_path"], "left_anti")
    return by_name.unionByName(missed)
