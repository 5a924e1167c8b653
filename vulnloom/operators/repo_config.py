"""Configuration that repositories bring along: one row per repository with a file of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.config import UNREADABLE, USER_CONFIG, RuleConfig, read_yaml
from vulnloom.constants import SEVERITY_RANK
from vulnloom.functions.paths import file_name, glob_regex, normalize_path, normalized
from vulnloom.functions.text import let
from vulnloom.operators.skew import salted_join

CONFIG = "disabled array<string>, prefixes array<string>, globs string, min_rank int"


def compiled(config: RuleConfig) -> tuple[list[str], list[str], str | None, int]:
    """The parts of a configuration that filter rows, in the order of `CONFIG`."""
    return (
        [name for name, on in config.checks.items() if not on],
        [p.rstrip("/") for p in map(normalized, config.exclude_paths) if p],
        "|".join(glob_regex(g) for g in config.exclude_patterns) or None,
        SEVERITY_RANK.get(config.min_severity, 1),
    )


def read_configs(files: DataFrame) -> DataFrame:
    """`repo_id, config, reason` of the repositories with a configuration file at their root.

    `reason` is null where the file could be read, else `config` is empty.
    """
    texts = files.filter(F.col("relative_path") == USER_CONFIG).select("repo_id", "content")
    rows = texts.mapInPandas(_reader(), f"repo_id string, {CONFIG}, reason string")
    config = F.struct(*[c.split()[0] for c in CONFIG.split(", ")])
    return rows.select("repo_id", F.when(F.col("reason").isNull(), config).alias("config"), "reason")


def repo_configs(files: DataFrame) -> DataFrame:
    """`repo_id, config` of the repositories with a readable configuration file."""
    return read_configs(files).filter("reason is null").select("repo_id", "config")


def config_rejects(files: DataFrame) -> DataFrame:
    """`repo_id, path, stage, reason` of the configuration files that cannot be read."""
    bad = read_configs(files).filter("reason is not null")
    return bad.select("repo_id", F.lit(USER_CONFIG).alias("path"), F.lit("config").alias("stage"), "reason")


def _reader():
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["repo_id", *[c.split()[0] for c in CONFIG.split(", ")], "reason"]
        for batch in batches:
            rows = []
            for repo_id, content in zip(batch["repo_id"], batch["content"], strict=True):
                try:
                    data = read_yaml(content or "")
                    if data is not None and not isinstance(data, dict):
                        raise ValueError("not a mapping")
                    rows.append((repo_id, *compiled(RuleConfig.from_dict(data or {})), None))
                except UNREADABLE as error:
                    rows.append((repo_id, None, None, None, None, f"{type(error).__name__}: {error}"[:200]))
            out = pd.DataFrame(rows, columns=columns)
            out["min_rank"] = out["min_rank"].astype("Int32")
            yield out

    return read


def with_config(rows: DataFrame, configs: DataFrame, default: RuleConfig, spread_by: list[str]) -> DataFrame:
    """Rows with the `config` of their repository, the default where it has none."""
    disabled, prefixes, globs, rank = compiled(default)
    fallback = F.struct(
        F.array(*[F.lit(x) for x in disabled]).cast("array<string>").alias("disabled"),
        F.array(*[F.lit(x) for x in prefixes]).cast("array<string>").alias("prefixes"),
        F.lit(globs).cast("string").alias("globs"),
        F.lit(rank).alias("min_rank"),
    )
    joined = salted_join(rows, configs, ["repo_id"], spread_by, "left")
    return joined.withColumn("config", F.coalesce("config", fallback))


def excluded(path: Column, config: Column) -> Column:
    def by_path(normal: Column) -> Column:
        under = F.exists(config["prefixes"], lambda p: (normal == p) | F.startswith(normal, F.concat(p, F.lit("/"))))
        globs = config["globs"]
        return under | F.coalesce(F.rlike(normal, globs) | F.rlike(file_name(normal), globs), F.lit(False))

    return let(normalize_path(path), by_path)


def excluded_by(path: Column, config: Column, default: RuleConfig) -> Column:
    """Whether a repository's own configuration, or the default where it is null, excludes the path."""
    return F.when(config.isNull(), default.excludes(path)).otherwise(excluded(path, config))


def filter_findings(findings: DataFrame, configs: DataFrame, default: RuleConfig) -> DataFrame:
    """Findings that their own repository's configuration keeps."""
    keyed = with_config(findings, configs, default, ["file_path", "line_start"])
    config = F.col("config")
    kept = ~F.array_contains(config["disabled"], F.col("vuln_type")) & ~excluded(F.col("file_path"), config)
    return keyed.filter(kept).drop("config")


def severity_gate(enriched: DataFrame, configs: DataFrame, default: RuleConfig) -> DataFrame:
    ranks = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    rank = F.coalesce(F.try_element_at(ranks, F.lower("severity")), F.lit(0))
    keyed = with_config(enriched, configs, default, ["file_path", "line_start"])
    return keyed.filter(rank >= F.col("config.min_rank")).drop("config")
