"""Byte-level BPE encoding and decoding with a vocabulary of ranks.

Texts are split by the scanner of `pretokens`; each slice goes through a cache of merged slices, so
the merging itself runs once for every distinct slice that a worker meets. Ids and the byte offsets
of their tokens travel as little-endian 32-bit integers, and decoding uses those offsets to lay the
bytes of all tokens out in one step.

A null text is an empty one and has no ids. Rows are handled one by one, so repeated rows give
repeated results. Only the named columns are read; all others are left out of the result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from vulnloom.llm.common import process_cache, text_chunks
from vulnloom.llm.pretokens import pieces

# Bytes that a worker keeps for merged slices in each of two generations; longer slices are merged each time.
CACHE_BYTES = 12 << 20
CACHED_BYTES = 48
# What an entry takes besides its slice and its ids: the objects' heads and its place in the table.
ENTRY_BYTES = 180
# Above this many symbols a heap of pairs is faster than looking for the lowest rank.
HEAP_FROM = 64
_NONE = 1 << 62


class Ranks:
    """The vocabulary: pairs of ids with the id they merge into, and the bytes of each id."""

    def __init__(self, lines: bytes) -> None:
        ranks = {}
        for line in lines.split(b"\n"):
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.whole = ranks
        self.pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the pair of the lowest rank merges, the leftmost of equals first."""
        if (whole := self.whole.get(piece)) is not None:
            return [whole]
        single = self.single
        ids = [single[b] for b in piece]
        if len(ids) >= HEAP_FROM:
            return self._merge_long(ids)
        get = self.pairs.get
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            ids[i] = low
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | low, _NONE)
            if i < len(ranks):
                ranks[i] = get(low << 32 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << 32 | ids[k])) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 32 | rank)) is not None:
                heappush(heap, (r, h))
        return [x for x in ids if x >= 0]


class Cache(dict):
    """Results by slice, in two generations, so that frequent slices stay and memory is bounded."""

    def __init__(self, make) -> None:
        self.make, self.older, self.held = make, {}, 0

    def __missing__(self, piece: bytes):
        found = self.older.get(piece)
        if found is None:
            found = self.make(piece)
            if len(piece) > CACHED_BYTES:
                return found
        if self.held >= CACHE_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()
        self[piece] = found
        self.held += ENTRY_BYTES + len(piece) + (len(found) if isinstance(found, bytes) else 0)
        return found


def _encoded(texts: list[bytes], ranks: Ranks, cache: Cache) -> tuple[list[bytes], list[bytes]]:
    """Ids of each text, and the byte offset at which each of its tokens ends."""
    slices, counts = pieces(texts)
    merged = list(map(cache.__getitem__, slices))
    ids, ends, a = [], [], 0
    for b in counts.tolist():
        own = b"".join(merged[a:b])
        a = b
        ids.append(own)
        ends.append(np.cumsum(ranks.lengths[np.frombuffer(own, "<u4")]).astype("<u4").tobytes())
    return ids, ends


def _decoded(ids: bytes, ends: bytes, ranks: Ranks) -> bytes:
    """The bytes of all tokens, each written up to its offset."""
    if not ids:
        return b""
    ids, ends = np.frombuffer(ids, "<u4"), np.frombuffer(ends, "<u4").astype(np.int64)
    lengths = np.diff(ends, prepend=0)
    shift = ranks.starts[ids] - (ends - lengths)
    return ranks.bytes[np.repeat(shift, lengths) + np.arange(ends[-1])].tobytes()


class Coder:
    """The vocabulary in a file of ranks, as the tasks use it.

    The driver reads and broadcasts the file: it has the size of a vocabulary, not of the data.
    """

    def __init__(self, df: DataFrame, ranks_path: str) -> None:
        self.name = ranks_path
        self.lines: Broadcast = df.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def ranks(self) -> Ranks:
        return process_cache(f"ranks {self.name}", lambda: Ranks(self.lines.value))

    def encoded(self, texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        ranks = self.ranks()
        merge = lambda piece: np.array(ranks.merge(piece), "<u4").tobytes()
        return _encoded(texts, ranks, process_cache(f"slices {self.name}", lambda: Cache(merge)))

    def decoded(self, ids: bytes, ends: bytes) -> bytes:
        return _decoded(ids, ends, self.ranks())


def encode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, ends): ids of each text and the byte offset at which each token ends."""
    coder = Coder(df, ranks_path)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch, "text"):
                columns = [pa.array(x, pa.binary()) for x in coder.encoded(texts)]
                yield pa.record_batch([batch.column("id").slice(first, len(texts)), *columns], ["id", "ids", "ends"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    encoded = source.mapInArrow(run, f"id {id_type}, ids binary, ends binary")
    return encoded.select(F.col("id").alias(id_col), "ids", "ends")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, decoded): the bytes that the ids of each row of `encode` stand for."""
    coder = Coder(encoded, ranks_path)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("ids"), batch.column("ends"))
            texts = [coder.decoded(a.as_py() or b"", b.as_py() or b"") for a, b in rows]
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.binary())], ["id", "decoded"])

    source = encoded.select(F.col(id_col).alias("id"), "ids", "ends")
    return source.mapInArrow(run, f"id {id_type}, decoded binary").select(F.col("id").alias(id_col), "decoded")


def digests(
    df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids]): encodes each text, then decodes its ids.

    Both happen in the same task, so decoded texts do not leave it, nor ids unless asked for.
    """
    coder = Coder(df, ranks_path)
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch, "text"):
                ids, ends = coder.encoded(texts)
                columns = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([sha256(coder.decoded(x, y)).hexdigest() for x, y in zip(ids, ends)], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.record_batch([batch.column("id").slice(first, len(texts)), *columns], names)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    found = source.mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), *names[1:])
