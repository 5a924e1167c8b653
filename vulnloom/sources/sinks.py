"""Writing reports and tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from vulnloom.operators.skew import cut

PIECE = ["section", "seq"]
# Bytes that are copied at a time where a document is put together.
COPY_BYTES = 8 << 20


def write_reports(reports: DataFrame, path: str) -> None:
    """Write reports as JSON lines, one line per row, spread over files by a hash of the repository.

    The number of files follows the shuffle partitions, not the number of repositories. Where a
    report was put together (`place`) is left out.
    """
    reports = reports.drop("place")
    keys = [c for c in ("repo_id", "part") if c in reports.columns]
    reports.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Write any operator's rows as parquet, clustered by repository for later pruning."""
    df.sortWithinPartitions("repo_id").write.mode("overwrite").parquet(path)


def _file_name(repo: str) -> str:
    """A repository's id as a file name, with what a path cannot hold written out."""
    return re.sub(r"[^A-Za-z0-9._-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), repo)


def write_documents(pieces: DataFrame, path: str, suffix: str) -> DataFrame:
    """Write one document per repository from its `pieces` (repo_id, section, seq, text); returns `repo_id, file, size`.

    Pieces are sorted into slices of the range of (repo_id, section, seq), and each task streams its
    slice into a part file per repository, so no row, task or driver ever holds a whole document. Parts
    are then copied together, a few megabytes at a time. `path` is a new folder. A task that runs again writes the same bytes to the same names,
    and documents appear under their final names only when all parts are written.
    """
    spark = pieces.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(f"{base}/_parts", recursive=True)
        repo, target, stream, size = None, None, None, 0
        for batch in batches:
            done = []
            for own, section, seq, text in batch.itertuples(index=False):
                if own != repo:
                    if stream is not None:
                        stream.close()
                        done.append((repo, target, size))
                    # The first piece of a part names it: parts sort by what they begin with.
                    repo, size = own, 0
                    target = f"_parts/{_file_name(own)}-{section:02d}-{seq + 1:020d}"
                    stream = store.open_output_stream(f"{base}/{target}", compression=None)
                data = text.encode("utf-8")
                stream.write(data)
                size += len(data)
            yield pd.DataFrame(done, columns=["repo_id", "part", "size"])
        if stream is not None:
            stream.close()
            yield pd.DataFrame([(repo, target, size)], columns=["repo_id", "part", "size"])

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            done = []
            for repo, parts, size in batch.itertuples(index=False):
                name = _file_name(repo) + suffix
                with store.open_output_stream(f"{base}/_parts/{name}.whole", compression=None) as out:
                    for part in parts:
                        with store.open_input_stream(f"{base}/{part}", compression=None) as source:
                            while data := source.read(COPY_BYTES):
                                out.write(data)
                store.move(f"{base}/_parts/{name}.whole", f"{base}/{name}")
                done.append((repo, name, size))
            yield pd.DataFrame(done, columns=["repo_id", "file", "size"])

    rows = pieces.select("repo_id", "section", F.coalesce("seq", F.lit(-1)).cast("bigint").alias("seq"), "text")
    sorted_rows = cut(rows).repartitionByRange(tasks, "repo_id", *PIECE)
    sorted_rows = sorted_rows.sortWithinPartitions("repo_id", *PIECE)
    parts = cut(sorted_rows.mapInPandas(write_parts, "repo_id string, part string, size bigint"))
    # A document has at most one part for each slice.
    listed = parts.groupBy("repo_id").agg(F.array_sort(F.collect_set("part")).alias("parts"), F.sum("size").alias("size"))
    return cut(listed.repartition(tasks, "repo_id").mapInPandas(put_together, "repo_id string, file string, size bigint"))
