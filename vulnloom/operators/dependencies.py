"""Declared dependencies from requirements files, pyproject.toml and package.json at a repository root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.functions.paths import file_name
from vulnloom.functions.text import let, split_lines, strip

# Which files count and how their lines read. A file may match several globs.
REQUIREMENT_GLOBS = [
    r"^requirements\.txt$",
    r"^requirements/[^/]*\.txt$",
    r"^requirements-[^/]*\.txt$",
    r"^req[^/]*\.txt$",
]
REQUIREMENT_LINE = r"^([A-Za-z0-9_.-]+)\s*([><=!~]+.*)?"
PYPROJECT_START = "dependencies = ["
PYPROJECT_END = "]"
PYPROJECT_LINE = r'^\s*"([A-Za-z0-9_.-]+)'
PACKAGE_JSON = "dependencies map<string,string>, devDependencies map<string,string>"


def _row(ecosystem: str, name: Column, version: Column) -> Column:
    return F.struct(
        F.lit(ecosystem).alias("ecosystem"), name.alias("name"), version.cast("string").alias("version_spec")
    )


def _requirements(content: Column) -> Column:
    lines = F.filter(F.transform(split_lines(content), strip), lambda x: x.rlike(r"^[A-Za-z0-9_.]"))
    return F.transform(
        lines,
        lambda x: _row(
            "python",
            F.regexp_extract(x, REQUIREMENT_LINE, 1),
            F.nullif(F.regexp_extract(x, REQUIREMENT_LINE, 2), F.lit("")),
        ),
    )


def _pyproject(content: Column) -> Column:
    """Names between the first start line and the next end line."""

    def block(lines: Column) -> Column:
        bare = F.transform(lines, strip)
        start = F.array_position(bare, F.lit(PYPROJECT_START))
        rest = F.slice(lines, start.cast("int") + 1, F.size(lines))
        end = F.array_position(F.transform(rest, strip), F.lit(PYPROJECT_END)).cast("int")
        body = F.when(end > 0, F.slice(rest, 1, F.greatest(end - 1, F.lit(0)))).otherwise(rest)
        named = F.filter(body, lambda x: x.rlike(PYPROJECT_LINE))
        rows = F.transform(named, lambda x: _row("python", F.regexp_extract(x, PYPROJECT_LINE, 1), F.lit(None)))
        return F.when(start > 0, rows)

    return let(split_lines(content), block)


def _package_json(content: Column) -> Column:
    def rows(section: Column) -> Column:
        entries = F.coalesce(F.map_entries(section), F.array().cast("array<struct<key:string,value:string>>"))
        return F.transform(entries, lambda e: _row("javascript", e["key"], e["value"]))

    return let(
        F.from_json(content, PACKAGE_JSON),
        lambda data: F.concat(rows(data["dependencies"]), rows(data["devDependencies"])),
    )


def _is_requirements(path: Column) -> Column:
    # The plain prefix can be checked against the statistics of a parquet file.
    return F.startswith(path, F.lit("req")) & path.rlike("|".join(REQUIREMENT_GLOBS))


def declared_in(path: Column, content: Column) -> Column:
    """The dependencies that a manifest file declares, as an array."""
    return (
        F.when(path == "pyproject.toml", _pyproject(content))
        .when(path == "package.json", _package_json(content))
        .when(_is_requirements(path), _requirements(content))
    )


def dependencies(files: DataFrame, duplicate_per_glob: bool = False) -> DataFrame:
    """One row per declared dependency, in one pass over the manifest files.

    With `duplicate_per_glob`, a requirements file counts once for every glob it matches. `files` has
    the texts, or the arrays of `declared_in` as `declared`.
    """
    path = F.col("relative_path")
    declared = F.col("declared") if "declared" in files.columns else declared_in(path, F.col("content"))
    wanted = files.filter(path.isin("pyproject.toml", "package.json") | _is_requirements(path))
    if duplicate_per_glob:
        globs = F.size(F.array_compact(F.array(*[F.when(path.rlike(g), 1) for g in REQUIREMENT_GLOBS])))
        copies = F.sequence(F.lit(1), F.greatest(globs, F.lit(1)))
        wanted = wanted.withColumn("_copy", F.explode(copies))
    rows = wanted.select("repo_id", "relative_path", F.posexplode(declared).alias("position", "d"))
    return rows.select(
        "repo_id",
        "d.ecosystem",
        "d.name",
        "d.version_spec",
        file_name(path).alias("source_file"),
        F.col("relative_path").alias("manifest_file"),
        "position",
    )


def manifest_files_found(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Manifest files per repository: those with rows, and any pyproject.toml."""
    with_rows = declared.select("repo_id", "manifest_file")
    pyproject = files.filter(F.col("relative_path") == "pyproject.toml").select(
        "repo_id", F.col("relative_path").alias("manifest_file")
    )
    return with_rows.unionByName(pyproject).distinct()
