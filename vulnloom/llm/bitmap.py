"""A set of 64-bit hashes as a bitmap, to pass over rows that cannot match.

It has 4 MiB, or more where that is less than `BITS_PER_KEY` bits for each hash, at which with three probes about
one row in 200 passes wrongly. The upper bound of its size, 128 MiB, serves 67 million hashes at that rate and
twice as many at one in 30; it bounds what is broadcast. A bitmap never misses a member; what it lets through besides is sorted out by an exact
join afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.llm.common import cut, packed, unpacked

BITS_PER_KEY = 16
LEAST_BITS, MOST_BITS = 25, 30
# Parts of a hash that say which bits stand for it.
SHIFTS = (0, 17, 34)


def build(hashes: DataFrame, column: str, bits_per_key: int = BITS_PER_KEY) -> np.ndarray:
    """Words of 32 bits; `column` holds well mixed 64-bit hashes of a stored table."""
    keys = max(hashes.count(), 1)
    bits = min(max((bits_per_key * keys - 1).bit_length(), LEAST_BITS), MOST_BITS)
    mask = (1 << bits) - 1
    places = [F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(mask)) for shift in SHIFTS]
    marked = hashes.select(F.explode(F.array(*places)).alias("place"))
    words = marked.groupBy(F.shiftright("place", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place % 32 AS INT))")).alias("bits")
    )
    found = words.select(F.col("word").cast("int"), F.col("bits").cast("bigint")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for all members and few others; `hashes` are unsigned."""
    inside = np.ones(len(hashes), bool)
    mask = np.uint64(len(words) * 32 - 1)
    for shift in SHIFTS:
        place = (hashes >> np.uint64(shift)) & mask
        inside &= (words[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32) & 1).astype(bool)
    return inside


def possible(words: Broadcast, hashes: Column) -> Column:
    """`contains` for a column of signed hashes; only that column goes through Python."""

    @F.pandas_udf("boolean")
    def inside(values: pd.Series) -> pd.Series:
        return pd.Series(contains(words.value, values.to_numpy(np.int64).view(np.uint64)))

    return inside(hashes)


def without(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of `df` whose id is not in `ids`; a null id is never in it.

    Only rows that the bitmap of `ids` lets through take part in the join, so the texts of all others
    are not shuffled. Columns may have any names.
    """
    named = cut(ids.select(F.col(id_col).alias("id")).where("id is not null").distinct())
    return without_keys(df.select(packed(df), F.col(id_col).alias("key")), named, df.columns)


def without_keys(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The `columns` of `rows` (row, key) whose key is not in the stored table `keys` (id)."""
    words = rows.sparkSession.sparkContext.broadcast(build(keys.select(F.xxhash64("id").alias("h")), "h"))
    inside = possible(words, F.xxhash64("key"))
    kept = rows.where(inside).join(keys, F.col("key") == F.col("id"), "left_anti")
    return unpacked(rows.where(~inside), columns).unionByName(unpacked(kept, columns))
