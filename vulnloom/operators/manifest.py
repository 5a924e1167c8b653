"""Repository manifests: which files count, how risky they are, and per-repository totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vulnloom.constants import SINGLE_CONTEXT_TOKENS
from vulnloom.functions import paths, text
from vulnloom.operators.skew import cut, top_n


def discovered(files: DataFrame) -> DataFrame:
    """Files outside skipped directories, with language (null if not source) and risk."""
    path = F.col("relative_path")
    return (
        files.filter(~paths.in_skipped_directory(path))
        .withColumn("language", paths.language(path))
        .withColumn("risk_level", paths.risk_level(path))
    )


def measured(files: DataFrame) -> DataFrame:
    """Source files with line counts and token estimates; the content itself is dropped here."""
    content = F.col("content")
    return (
        discovered(files)
        .filter(F.col("language").isNotNull())
        .withColumn("line_count", text.manifest_line_count(content))
        .withColumn("estimated_tokens", text.manifest_tokens(F.col("line_count")))
        .select(
            "repo_id", "relative_path", "language", "risk_level", "line_count", "estimated_tokens", "size_bytes"
        )
    )


def walk_order() -> list[Column]:
    """Riskiest first, then longest, then tree order."""
    return [paths.risk_rank(F.col("risk_level")), F.desc("line_count"), paths.parts(F.col("relative_path"))]


def manifest(files: DataFrame, max_files: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """All source files of each repository with their `rank`, or the first `max_files`.

    Contents are read once; what is written down and ranked is a narrow row per file. Files of one
    risk and length are ranked among themselves and get the number of files before them added, so
    no task orders all files of a large repository. `rows` are those of `measured`, if they are
    written down already.
    """
    if max_files is not None:
        rows = measured(files) if rows is None else rows
        return top_n(rows, ["repo_id"], walk_order(), max_files, ["relative_path"], "rank")
    rows = cut(measured(files)) if rows is None else rows
    group = ["repo_id", "risk_level", "line_count"]
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_size"))
    order = [paths.risk_rank(F.col("risk_level")), F.desc("line_count")]
    earlier = Window.partitionBy("repo_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*group, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*group).orderBy(paths.parts(F.col("relative_path"))))
    ranked = rows.withColumn("_within", within).join(before, group)
    return ranked.withColumn("rank", (F.col("_before") + F.col("_within")).cast("int")).select(*rows.columns, "rank")


def limit_counts(files: DataFrame, manifest_files: DataFrame) -> DataFrame:
    """`repo_id, source_files, files_included, files_over_limit`: what a limit on files has cut."""
    counts = discovered(files).groupBy("repo_id").agg(F.count("language").alias("source_files"))
    included = manifest_files.groupBy("repo_id").agg(F.count("*").alias("files_included"))
    joined = counts.join(included, "repo_id", "left").na.fill(0)
    return joined.withColumn("files_over_limit", F.col("source_files") - F.col("files_included"))


def files_at_risk(manifest_files: DataFrame, level: str) -> DataFrame:
    return manifest_files.filter(F.col("risk_level") == level)


def discovered_counts(files: DataFrame) -> DataFrame:
    """Files found per repository, whatever their language. Reads paths only."""
    return discovered(files).groupBy("repo_id").agg(F.count("*").alias("files_discovered"))


def _totals(manifest_files: DataFrame) -> DataFrame:
    return manifest_files.groupBy("repo_id").agg(
        F.count("*").alias("files_included"),
        F.sum("line_count").alias("total_lines"),
        F.sum("estimated_tokens").alias("total_estimated_tokens"),
        *[
            F.count_if(F.col("language") == value).alias(f"language_{value}")
            for value in ("python", "javascript", "typescript", "go", "rust", "java")
        ],
        *[F.count_if(F.col("risk_level") == value).alias(f"risk_{value}") for value in ("high", "medium", "low")],
    )


def _with_breakdowns(totals: DataFrame) -> DataFrame:
    """Count columns to maps that hold only the values that occur."""

    def as_map(prefix: str) -> Column:
        names = [c for c in totals.columns if c.startswith(prefix)]
        entries = F.array(*[F.struct(F.lit(c[len(prefix):]).alias("key"), F.col(c).alias("value")) for c in names])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))

    return totals.select(
        "repo_id",
        "files_discovered",
        "files_included",
        "files_excluded",
        "total_lines",
        "total_estimated_tokens",
        as_map("language_").alias("language_breakdown"),
        as_map("risk_").alias("risk_breakdown"),
        (F.col("total_estimated_tokens") < SINGLE_CONTEXT_TOKENS).alias("fits_single_context"),
    )


def _zero_if_null(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def manifest_summary(files: DataFrame, manifest_files: DataFrame) -> DataFrame:
    """One row per repository that has any file: counts, lines, tokens and breakdowns."""
    joined = _zero_if_null(discovered_counts(files).join(_totals(manifest_files), "repo_id", "left"))
    return _with_breakdowns(joined.withColumn("files_excluded", F.col("files_discovered") - F.col("files_included")))


def scoped_summary(summary: DataFrame, scoped_files: DataFrame) -> DataFrame:
    """Totals over the files left after diff scoping; the files scoped out count as excluded."""
    before = summary.select(
        "repo_id", "files_discovered", F.col("files_included").alias("_before"), F.col("files_excluded").alias("_excluded")
    )
    joined = _zero_if_null(before.join(_totals(scoped_files), "repo_id", "left"))
    dropped = F.greatest(F.lit(0), F.col("_before") - F.col("files_included"))
    return _with_breakdowns(joined.withColumn("files_excluded", F.col("_excluded") + dropped))


def breakdown(manifest_files: DataFrame, column: str) -> DataFrame:
    """Files per repository and value of `column` (`language` or `risk_level`)."""
    return manifest_files.groupBy("repo_id", column).agg(F.count("*").alias("files"))
