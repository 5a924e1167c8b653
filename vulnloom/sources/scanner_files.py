"""Scanner documents of any size, read in byte ranges that split one document between many tasks.

What a byte of JSON means depends on all before it: whether it lies in a string, and how deep. So a
first pass reads each range as if it began outside a string, inside one, and behind a backslash, and
notes for each case how it ends and how much deeper it gets. These notes, a few numbers per range, are
composed in order of the ranges of a document; a second pass then knows where it stands and cuts out
the elements of the lists at the top of the document that begin in its range. Which list that is
follows from the last key at the top, carried over from earlier ranges in the same way. Files without
a byte are no documents, as Spark does not list them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from vulnloom.operators.skew import cut
from vulnloom.sources.scanner import RESULTS

RANGE_BYTES = 32 << 20
# Bytes that a task looks at together.
CHUNK_BYTES = 1 << 20
# A key at the top of a document is looked for in so many bytes before its colon.
KEY_BYTES = 1 << 10
OUTSIDE, INSIDE, ESCAPED = range(3)
ELEMENT = RESULTS.removeprefix("results array<").removesuffix(">")
# Lists stand at depth 2 of a document and their elements at depth 3.
TOP, ELEMENT_DEPTH = 1, 3
# In place of an ordinal: the row names the last key of its range, or says that the results begin in it.
LAST_KEY, LISTS = -1, -2
_OPEN, _CLOSE = (np.isin(np.arange(256), list(signs.encode())) for signs in ("{[", "}]"))


class Lexed:
    """Which bytes of a chunk are signs of the document, not of its strings, and the state behind it."""

    def __init__(self, data: np.ndarray, state: int) -> None:
        n = len(data)
        at = np.arange(n)
        # A byte is escaped if an odd number of backslashes stands right before it; a chunk that begins
        # behind one has it as a byte at place -1.
        plain = data != 92
        last_plain = np.maximum.accumulate(np.where(plain, at, -2 if state == ESCAPED else -1)) if n else at
        before = np.concatenate([[-2 if state == ESCAPED else -1], last_plain[:-1]]) if n else at
        escaped = (at - 1 - before) % 2 == 1
        quotes = (data == 34) & ~escaped
        parity = np.cumsum(quotes)
        inside = (parity - quotes + (state != OUTSIDE)) % 2 == 1
        self.signs = ~inside & ~quotes
        ends_inside = (int(parity[-1]) if n else 0) + (state != OUTSIDE)
        self.end = state if not n else OUTSIDE if ends_inside % 2 == 0 else INSIDE
        if n and self.end == INSIDE and (n - 1 - last_plain[-1]) % 2 == 1:
            self.end = ESCAPED
        self.steps = np.where(self.signs, _OPEN[data].astype(np.int64) - _CLOSE[data], 0)


def _opened(path: str):
    store, base = fs.FileSystem.from_uri(path)
    return store.open_input_file(base)


def ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """`path, repo_id, number, start, stop, size`: the ranges of every document; the file's stem is the repo_id."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.json)?$", 1)
    starts = F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes))
    rows = files.select("path", stem.alias("repo_id"), "size", F.posexplode(starts).alias("number", "start"))
    return rows.withColumn("stop", F.least(F.col("start") + range_bytes, F.col("size")))


def _noted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each range and each state it may begin in: the state at its end and the change of depth."""
    for batch in batches:
        rows = []
        for path, number, start, stop in batch[["path", "number", "start", "stop"]].itertuples(index=False):
            ends, depths = [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0]
            with _opened(path) as file:
                for at in range(start, stop, CHUNK_BYTES):
                    data = np.frombuffer(file.read_at(min(CHUNK_BYTES, stop - at), at), np.uint8)
                    seen = {s: Lexed(data, s) for s in set(ends)}
                    depths = [d + int(seen[s].steps.sum()) for d, s in zip(depths, ends)]
                    ends = [seen[s].end for s in ends]
            rows.append((path, number, *ends, *depths))
        yield pd.DataFrame(rows, columns=["path", "number", "e0", "e1", "e2", "d0", "d1", "d2"])


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """The state and depth in which each range of a document begins, and whether the document ends whole."""
    rows = rows.sort_values("number", ignore_index=True)
    state, depth, states, depths = OUTSIDE, 0, [], []
    for ends, changes in zip(rows[["e0", "e1", "e2"]].to_numpy(), rows[["d0", "d1", "d2"]].to_numpy()):
        states.append(state)
        depths.append(depth)
        state, depth = int(ends[state]), depth + int(changes[state])
    return pd.DataFrame({"path": rows["path"], "number": rows["number"], "state": states, "depth": depths, "whole": state == OUTSIDE and depth == 0})


def _key_before(file, colon: int) -> str | None:
    """The key whose colon stands at a place of the document."""
    start = max(0, colon - KEY_BYTES)
    found = re.search(rb'"((?:[^"\\]|\\.)*)"\s*$', file.read_at(colon - start, start))
    return found and found[1].decode("utf-8", "replace")


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The elements that begin in each range, with the last key at the top before them, null if that was
    in an earlier range; and for each range rows without element, for the last key in it and for a list of results."""
    columns = ["path", "number", "ordinal", "key", "element"]
    for batch in batches:
        for path, number, start, stop, size, state, depth in batch[["path", "number", "start", "stop", "size", "state", "depth"]].itertuples(index=False):
            key, listed, rows, open_at, held, held_at, at, ordinal = None, False, [], None, b"", start, start, 0
            with _opened(path) as file:
                # Beyond its range a task reads on only until the element that it is in is closed.
                while at < size and (at < stop or open_at is not None):
                    data = file.read_at(min(CHUNK_BYTES, (stop if at < stop else size) - at), at)
                    chunk = np.frombuffer(data, np.uint8)
                    lexed = Lexed(chunk, state)
                    depths = depth + np.cumsum(lexed.steps)
                    held += data
                    begins = np.flatnonzero((lexed.steps == 1) & (depths == ELEMENT_DEPTH)) + at
                    ends = np.flatnonzero((lexed.steps == -1) & (depths == ELEMENT_DEPTH - 1)) + at
                    colons = np.flatnonzero((chunk == 58) & lexed.signs & (depths == TOP)) + at
                    for place, kind in sorted([(p, 0) for p in begins] + [(p, 1) for p in ends] + [(p, 2) for p in colons]):
                        if kind == 0 and place < stop:
                            open_at = place
                        elif kind == 1 and open_at is not None:
                            rows.append((path, number, ordinal, key, held[open_at - held_at : place + 1 - held_at].decode("utf-8", "replace")))
                            ordinal, open_at = ordinal + 1, None
                            if place >= stop:
                                break
                        elif kind == 2 and place < stop:
                            key = _key_before(file, int(place))
                            listed |= key == "results"
                    state, depth, at = lexed.end, int(depths[-1]), at + len(data)
                    keep = at if open_at is None else open_at
                    held, held_at = held[keep - held_at :], keep
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame([*rows, *[(path, number, LISTS, "results", None)] * listed, (path, number, LAST_KEY, key, None)], columns=columns)


def _carried(rows: pd.DataFrame) -> pd.DataFrame:
    """For each range the key that it begins under and the number of results in the ranges before it."""
    rows = rows.sort_values("number", ignore_index=True)
    key, offset, keys, offsets, has_results = None, 0, [], [], False
    for last, named, unnamed, lists in zip(rows["last"], rows["named"], rows["unnamed"], rows["lists"]):
        keys.append(key)
        offsets.append(offset)
        offset += int(named) + (int(unnamed) if key == "results" else 0)
        key = last if isinstance(last, str) else key
        has_results |= bool(lists)
    return pd.DataFrame({"path": rows["path"], "number": rows["number"], "inherited": keys, "offset": offsets, "listed": has_results})


class Documents:
    """The scanner outputs at `path`, of any size each: `results()` as `scanner.scanner_results` has them, and `rejects()`."""

    def __init__(self, spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> None:
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # Dealt out by range, as the documents are what may be few and large.
        dealt = cut(ranges(spark, path, range_bytes)).repartition(tasks, "path", "number")
        notes = dealt.mapInPandas(_noted, "path string, number int, e0 int, e1 int, e2 int, d0 bigint, d1 bigint, d2 bigint")
        places = notes.groupBy("path").applyInPandas(_composed, "path string, number int, state int, depth bigint, whole boolean")
        self.ranges = cut(dealt.join(places, ["path", "number"]))
        read = self.ranges.repartition(tasks, "path", "number").mapInPandas(
            _elements, "path string, number int, ordinal int, key string, element string"
        )
        self.elements = cut(read)
        named = F.count_if((F.col("ordinal") >= 0) & (F.col("key") == "results")).alias("named")
        unnamed = F.count_if((F.col("ordinal") >= 0) & F.col("key").isNull()).alias("unnamed")
        last = F.max(F.when(F.col("ordinal") == LAST_KEY, F.col("key"))).alias("last")
        lists = F.max(F.col("ordinal") == LISTS).alias("lists")
        counted = self.elements.groupBy("path", "number").agg(named, unnamed, last, lists)
        self.carried = cut(
            counted.groupBy("path").applyInPandas(
                _carried, "path string, number int, inherited string, offset bigint, listed boolean"
            )
        )

    def _judged(self) -> DataFrame:
        """`path, repo_id, whole, listed` of each document."""
        whole = self.ranges.groupBy("path", "repo_id").agg(F.first("whole").alias("whole"))
        return whole.join(self.carried.groupBy("path").agg(F.max("listed").alias("listed")), "path")

    def results(self) -> DataFrame:
        """`repo_id, pos, r`: one row per result, in order; documents that `rejects` names have none."""
        good = self._judged().filter("whole AND listed").select("path", "repo_id")
        rows = self.elements.filter("ordinal >= 0").join(self.carried, ["path", "number"]).join(good, "path")
        rows = rows.withColumn("own", F.coalesce("key", "inherited")).filter("own = 'results'")
        # Ordinals count all elements of a range; those of other lists stand before or after the results in it.
        first = F.min("ordinal").alias("first")
        firsts = rows.groupBy("path", "number").agg(first)
        numbered = rows.join(firsts, ["path", "number"])
        pos = (F.col("offset") + F.col("ordinal") - F.col("first")).cast("int")
        return numbered.select("repo_id", pos.alias("pos"), F.from_json("element", ELEMENT).alias("r"))

    def rejects(self) -> DataFrame:
        """`repo_id, path, stage, reason` of the documents that are cut off or have no list of results."""
        reason = F.when(~F.col("whole"), "not JSON").otherwise("no results")
        return self._judged().filter("NOT (whole AND listed)").select(
            "repo_id", F.lit(None).cast("string").alias("path"), F.lit("scanner").alias("stage"), reason.alias("reason")
        )
