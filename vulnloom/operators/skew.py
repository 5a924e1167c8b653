"""Joins, top-n and numbering that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A table of keys up to this size is sent to every executor; a larger one is joined otherwise.
BROADCAST_BYTES = 64 << 20


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and go on from there.

    The folder is the one the cluster names in `spark.checkpoint.dir`, which executors share, so
    a lost executor does not lose the result. A parquet copy lets later steps read only the
    columns they need and tells the optimizer how large it is. Only a local session falls back to
    a folder of its own. The tables of an application share one folder until `close` removes it.
    """
    path = checkpoint_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_path(spark: SparkSession) -> str:
    """A new path beside the tables of `cut`, which `close` removes with them."""
    return f"{_scratch(spark)}/{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    return f"{_checkpoint_dir(spark).rstrip('/')}/vulnloom-{spark.sparkContext.applicationId}"


def close(spark: SparkSession) -> None:
    """Remove all tables that `cut` has written for this application; call it once results are stored."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _checkpoint_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@functools.cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="vulnloom-checkpoint-")


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True if the rows of `df`, with all that their columns hold, come to at most `limit` bytes as JSON."""
    size = F.octet_length(F.to_json(F.struct(*df.columns))).cast("bigint")
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def _salts(spark: SparkSession) -> int:
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)


def salted_join(
    many: DataFrame, few: DataFrame, on: list[str], spread_by: list[str], how: str = "inner"
) -> DataFrame:
    """Join a table with hot keys to a table with few rows per key.

    Each key of `many` is spread over tasks by a hash of `spread_by`; `few` is repeated once per
    salt. There are about as many salts as tasks can be of use for one key that holds a third of
    the rows.
    """
    salts = _salts(many.sparkSession)
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def top_n(
    df: DataFrame, keys: list[str], order: list[Column], n: int, spread_by: list[str], rank: str
) -> DataFrame:
    """First `n` rows of each key with their rank from 1.

    Every salt of a key first keeps its own first `n`, so the task that ranks a hot key sees at
    most `n` rows per salt, whatever the size of the key.
    """
    salts = _salts(df.sparkSession)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    within_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
    within_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(within_salt))
        .filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
        .withColumn(rank, F.row_number().over(within_key))
        .filter(F.col(rank) <= n)
    )


def sorted_slices(
    df: DataFrame, keys: list[str], order: list[str], slices: int | None = None, stored: bool = False
) -> DataFrame:
    """`df` written down in slices of the range of (`keys`, `order`), numbered in `_slice`.

    Slice numbers are written with the rows, because a recomputed range sort could move a row. Finding
    the ranges reads `df` once more, so it is written down first, unless it is little more than the
    rows of a `stored` table.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut((df if stored else cut(df)).repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id()))


def running_totals(sliced: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows of `sorted_slices` with running totals of the key, each row's own value included.

    Each slice is added up on its own, and a table of slice totals gives the offsets, so no task
    holds more than a slice of a key. `order` must be unique within a key.
    """
    valued = sliced.withColumns({f"_of_{n}": v for n, v in sums.items()})
    totals = valued.groupBy(*keys, "_slice").agg(*[F.sum(f"_of_{n}").alias(f"_sum_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums]
    offsets = totals.select(*keys, "_slice", *before)
    through = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = valued.withColumns({f"_through_{n}": F.sum(f"_of_{n}").over(through) for n in sums}).join(offsets, [*keys, "_slice"])
    out = out.withColumns({n: (F.col(f"_before_{n}") + F.col(f"_through_{n}")).cast("bigint") for n in sums})
    return out.drop(*[f"_{part}_{n}" for part in ("of", "before", "through") for n in sums])


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], name: str, running: str | None = None, stored: bool = False
) -> DataFrame:
    """Number the rows of each key from 1 in `order`, which must be unique within the key.

    With `running`, also add `<running>_total`, the sum of that column up to and including the row.
    `stored` says that `df` is little more than the rows of a table (`sorted_slices`).
    """
    sums = {name: F.lit(1)} | ({f"{running}_total": F.col(running)} if running else {})
    return running_totals(sorted_slices(df, keys, order, stored=stored), keys, order, sums).drop("_slice")
