"""Repository metadata from addresses and remotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vulnloom.functions.paths import repo_name, repo_url_parts


def parsed_urls(repos: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(rows with `owner, repo, branch, repo_name`, rows whose address is not acceptable)."""
    parsed = repos.withColumn("_parts", repo_url_parts(F.col(url)))
    accepted = parsed.filter(F.col("_parts").isNotNull()).select(
        *repos.columns, "_parts.owner", "_parts.repo", "_parts.branch",
        F.concat_ws("/", "_parts.owner", "_parts.repo").alias("repo_name"),
    )
    return accepted, parsed.filter(F.col("_parts").isNull()).select(*repos.columns)


def local_repos(repos: DataFrame) -> DataFrame:
    """Metadata of local checkouts from `repo_id, directory, remote_url, branch, commit_hash,
    commit_date, scan_timestamp`; what git could not tell becomes `local`, the date the scan's."""
    commit_date = F.coalesce(F.try_to_timestamp(F.col("commit_date")), F.col("scan_timestamp"))
    return repos.select(
        "repo_id",
        repo_name(F.col("remote_url"), F.col("directory")).alias("repo_name"),
        F.coalesce("remote_url", F.concat(F.lit("file://"), "directory")).alias("repo_url"),
        F.coalesce("branch", F.lit("local")).alias("branch"),
        F.coalesce("commit_hash", F.lit("local")).alias("commit_hash"),
        commit_date.alias("commit_date"),
        F.lit(0).alias("clone_depth"),
        "scan_timestamp",
    )
