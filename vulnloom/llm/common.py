"""What the operators of this package share: lineage cuts, Arrow helpers and per-process caches."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vulnloom.functions.text import let

# Texts are handed to numpy in groups of about this many bytes, whatever the size of an Arrow batch.
CHUNK_BYTES = 1 << 18
# What an Arrow batch of texts may hold in a job of many stages.
BATCH_BYTES = 4 << 20


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` to the folder in `spark.checkpoint.dir` and goes on from there.

    The folder is shared, so a lost executor loses nothing. Only a local session without that
    setting gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="vulnloom-checkpoint-")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that are no longer in use.

    It does so when the driver collects its garbage, which a driver with little to do hardly ever
    does on its own, so the files of a job with many steps would pile up on the executors.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session to `BATCH_BYTES`, unless it was started with another bound.

    Spark's own bound is 64 MiB, of which the JVM and the Python worker of each core hold copies.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def packed(df: DataFrame) -> Column:
    """All columns of `df` in one, named `row`, so that columns added beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that `packed` has put into `row`."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running results of `combine` over an array of longs, each value included.

    In groups of the square root of its size: an array that grows by one element at a time is copied
    each time, so one pass over n values would copy n * n / 2 of them.
    """
    none, first = F.array().cast("array<bigint>"), F.lit(zero).cast("bigint")
    merge = lambda a, b: combine(a, b)  # noqa: E731  higher-order functions look at the signature

    def through(group: Column, before: Column) -> Column:
        def step(state: Column, value: Column) -> Column:
            now = combine(state["at"], value)
            return F.struct(now.alias("at"), F.concat(state["out"], F.array(now)).alias("out"))

        return F.aggregate(group, F.struct(before.alias("at"), none.alias("out")), step)["out"]

    def over_groups(groups: Column) -> Column:
        totals = F.transform(groups, lambda g: F.aggregate(g, first, merge))
        # The last total is not needed: no group comes after it.
        before = F.concat(F.array(first), through(F.slice(totals, 1, F.size(totals) - 1), first))
        return F.flatten(F.zip_with(groups, before, through))

    def of(all_: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_))).cast("int")
        groups = F.transform(F.sequence(F.lit(1), F.size(all_), width), lambda a: F.slice(all_, a, width))
        return F.when(F.size(all_) > 0, let(groups, over_groups)).otherwise(none)

    return let(values, of)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no classifier learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def process_cache(name: str, make: Callable[[], object]) -> object:
    """An object that stays in a Python worker from task to task.

    The package travels with its tasks by value, so its own globals are new in each of them.
    """
    holder = sys.modules.setdefault("_vulnloom_process_cache", types.ModuleType("_vulnloom_process_cache"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch as UTF-8, null as empty, in runs of about `limit` bytes with their first row."""
    values = batch.column(column).cast(pa.binary())
    first, held, size = 0, [], 0
    for i in range(len(values)):
        text = values[i].as_py() or b""
        held.append(text)
        size += len(text)
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held
