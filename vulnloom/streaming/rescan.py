"""Diff-scoped rescans as a stream: every new file version is a changed file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vulnloom.config import RuleConfig
from vulnloom.operators.detection import detect
from vulnloom.operators.findings import dedup_findings

FILE = ["repo_id", "file_path"]


def rescan(files: DataFrame, output: str, checkpoint: str, config: RuleConfig | None = None) -> StreamingQuery:
    """Scan a stream of `files` rows; each batch adds what it has found and which files it has looked at.

    Findings lie under `output/findings/batch=<n>`, files under `output/files/batch=<n>`. The files of a
    batch are written last, and a batch counts only where they are there. A repeated batch overwrites
    its own folders, so a restart adds nothing twice. A file with several versions in one batch has
    the findings of all of them.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = dedup_findings(detect(batch, config or RuleConfig())).drop("first_seq")
        found.write.mode("overwrite").parquet(f"{output}/findings/batch={number}")
        seen = batch.select("repo_id", F.col("relative_path").alias("file_path")).distinct()
        seen.write.mode("overwrite").parquet(f"{output}/files/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_findings(spark: SparkSession, output: str) -> DataFrame:
    """The findings of the last version of each file: a rescan takes back what its older versions had.

    Which batch saw a file last is an aggregate over narrow rows, and findings of that batch are
    picked by an equi-join; findings of files that have none any more find no partner.
    """
    last = spark.read.parquet(f"{output}/files").groupBy(*FILE).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{output}/findings").join(last, [*FILE, "batch"], "left_semi")


def compact(spark: SparkSession, output: str, target: str) -> None:
    """Write the current findings as one table, for readers that want no history."""
    current_findings(spark, output).drop("batch").write.mode("overwrite").parquet(target)
