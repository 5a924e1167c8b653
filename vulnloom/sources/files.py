"""The `files` table: `repo_id, relative_path, content, size_bytes`."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vulnloom.functions.paths import normalize_path
from vulnloom.functions.text import decode_utf8, universal_newlines
from vulnloom.operators.skew import cut

Batches = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
# Bytes of content a reading task hands on at a time.
READ_BATCH_BYTES = 16 << 20


def _children(root: str) -> Batches:
    """Lists the folders of each batch. Links to folders are not followed; `.git` is left out."""

    def list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch["path"]:
                rows = []
                for info in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                    is_folder = info.type == fs.FileType.Directory
                    if is_folder and (info.base_name == ".git" or (local and os.path.islink(info.path))):
                        continue
                    if is_folder or info.type == fs.FileType.File:
                        path = f"{folder}/{info.base_name}".lstrip("/")
                        rows.append((path, is_folder, 0 if is_folder else info.size))
                yield pd.DataFrame(rows, columns=["path", "is_folder", "size"])

    return list_folders


def _contents(root: str) -> Batches:
    """Reads the files of each batch. A file that is gone or closed to us gets an `error`; any other
    failure of the store ends the task, which Spark then repeats."""

    def read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        columns = ["path", "content", "size", "error"]
        rows, held = [], 0
        for batch in batches:
            for path, size in zip(batch["path"], batch["size"], strict=True):
                content, error = b"", None
                try:
                    with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                        content = stream.read()
                except (FileNotFoundError, PermissionError) as failure:
                    error = f"{type(failure).__name__}: {failure}"[:200]
                rows.append((path, content, size, error))
                held += len(content)
                if held >= READ_BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    return read_files


def list_trees(spark: SparkSession, root: str) -> DataFrame:
    """`path, size` of all files below `root`, one Spark job per folder level.

    Spark's own file sources leave out names that start with a dot or an underscore, which would
    lose `.env` and `__init__.py`.
    """
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folders = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        listed = folders.repartition(tasks, "path").mapInPandas(
            _children(root), "path string, is_folder boolean, size bigint"
        )
        listed = cut(listed)
        levels.append(listed.filter(~F.col("is_folder")).select("path", "size"))
        folders = listed.filter("is_folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def read_with_errors(spark: SparkSession, root: str, wanted: Column | None = None) -> DataFrame:
    """A `files` table of the repositories below `root`, one folder each, with an `error` column.

    `wanted` is a condition on `repo_id`, `relative_path` and `size_bytes`, which the listing knows, such as
    `paths.language(...)` or a limit: no other file is opened.

    The folder name is the repo_id; `root` is a path or address that all executors can read. Write
    the result as parquet once: a table lists and prunes far faster than a tree of small files, and
    `unreadable` then needs no second reading.
    """
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    repo, path = F.split("path", "/")[0].alias("repo_id"), F.regexp_replace("path", "^[^/]*/", "").alias("relative_path")
    listed = list_trees(spark, root).filter(F.contains("path", F.lit("/")))
    if wanted is not None:
        listed = listed.select("path", "size", repo, path, F.col("size").alias("size_bytes")).filter(wanted)
    read = listed.select("path", "size").repartition(tasks, "path").mapInPandas(
        _contents(root), "path string, content binary, size bigint, error string"
    )
    return read.select(repo, path, decode_utf8(F.col("content")).alias("content"), F.col("size").alias("size_bytes"), "error")


def read_trees(spark: SparkSession, root: str, wanted: Column | None = None) -> DataFrame:
    """The files of `read_with_errors` that could be read."""
    return read_with_errors(spark, root, wanted).filter("error is null").drop("error")


def write_tree(files: DataFrame, root: str) -> None:
    """Write each row of a `files` table as a file `root/repo_id/relative_path`, the inverse of `read_trees`.

    A repeated task writes the same bytes again.
    """

    def write_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        folders = set()
        for batch in batches:
            for repo, path, content in zip(batch["repo_id"], batch["relative_path"], batch["content"], strict=True):
                target = f"{base}/{repo}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in folders:
                    store.create_dir(folder, recursive=True)
                    folders.add(folder)
                with store.open_output_stream(target, compression=None) as stream:
                    stream.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    rows = files.select("repo_id", "relative_path", F.coalesce("content", F.lit("")).cast("binary").alias("content"))
    rows.mapInPandas(write_files, "n bigint").agg(F.sum("n")).collect()


def unreadable(files: DataFrame) -> DataFrame:
    """`repo_id, path, stage, reason` of the files that could not be read."""
    return files.filter("error is not null").select(
        "repo_id", F.col("relative_path").alias("path"), F.lit("read").alias("stage"), F.col("error").alias("reason")
    )


def as_files(table: DataFrame) -> DataFrame:
    """A `files` table from any `repo_id, relative_path, content` table of texts.

    Paths are normalised here once, so that later joins on them are plain equality.
    """
    return table.select(
        "repo_id",
        normalize_path(F.col("relative_path")).alias("relative_path"),
        universal_newlines(F.col("content")).alias("content"),
        F.octet_length("content").cast("bigint").alias("size_bytes"),
    )


def save_files(files: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Save a `files` table bucketed by repository and path, and return it.

    Digests and patches fetch the texts of few files by that key; on a bucketed table only the
    keys are shuffled to the texts, never the texts themselves.
    """
    writer = files.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, "repo_id", "relative_path").sortBy("repo_id", "relative_path").saveAsTable(table)
    return files.sparkSession.table(table)
