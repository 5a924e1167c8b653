"""Exact k-means over integer vectors, by the Shallot search.

Each component x becomes floor(1024 * x). A vector remembers its centroid, the second nearest one, an
upper bound of its distance to the first and a lower bound of that to all others. When centroids move,
the bounds move with them; a vector whose upper bound stays below its lower bound keeps its centroid
without any distance being taken. Otherwise the distances to both remembered centroids are taken, the
closer of them is the centre of the search, and the others are met in order of their distance to that
centre. None outside a ball of radius d(vector, centre) + d(vector, second nearest so far) can be
among the nearest two, and the ball shrinks with every closer one. Survivors are compared in exact
integers, ties go to the smaller number, so the result equals that of comparing with all centroids;
bounds are floats with a margin for their rounding.

Work is laid out in blocks of vectors: integers once, in a table bucketed by block, and per round a
narrow table of bounds and of the sums of each block. A round joins bounds to blocks without moving
vectors, sums by centroid in Spark, and brings `k` rows of sums to the driver; centroids go out as a
broadcast of k vectors and a table of k * k distances (k is at most `MAX_K`). Every round is written
to the folder in `spark.checkpoint.dir`, so a lost executor repeats one round of its blocks at most.

Cases: rows whose vector is null, of another length, or with a null or non-finite component are left
out, as the contract says; a null id is kept, but no centroid starts there. Repeated rows and ids are
vectors of their own; equal hashes are taken in order of components. With fewer than `k` vectors there
are fewer centroids; without any the result is empty. A component beyond +-131,072 counts as that, so
that every squared distance fits a long; a sum of distances that does not fit one is null. Other
columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from vulnloom.operators.skew import checkpoint_path, cut

SCALE = 1024
# 64 components apart by twice this still have a squared distance below 2**63.
LIMIT = 1 << 27
BLOCK = 4096
# Bounds the k * k distances between centroids that each round sends out.
MAX_K = 2048


def kept(vectors: DataFrame, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, parts): the usable vectors as arrays of integers."""
    x = F.col(vector_col)
    usable = x.isNotNull() & (F.size(x) == dims) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = lambda v: F.floor(F.least(F.greatest(v.cast("double") * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT))))
    return vectors.where(usable).select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("parts"))


def start(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of `<seed>:<id>`, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.where("vec_id is not null").select(key.alias("key"), "parts").orderBy("key", "parts").limit(k)
    return np.array([r.parts for r in first.collect()], np.int64)


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, row by row; in 64-bit integers throughout."""
    apart = points - centres
    return np.einsum("ij,ij->i", apart, apart)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-9) + 1e-9


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - 1e-9) - 1e-9


class Centres:
    """Centroids of a round, how far each has moved, and the others around each by distance."""

    def __init__(self, parts: np.ndarray, before: np.ndarray | None = None) -> None:
        self.parts = parts
        self.moved = np.zeros(len(parts))
        if before is not None:
            self.moved = _up(np.sqrt(_squares(parts, before).astype(float)))
        # The farthest move among the others of each centroid: the overall one, or the next if it is its own.
        order = np.sort(self.moved)[::-1]
        most = order[0]
        self.others_moved = np.where(self.moved == most, order[min(1, len(order) - 1)] if (self.moved == most).sum() == 1 else most, most)
        apart = np.stack([np.sqrt(_squares(parts, p).astype(float)) for p in parts])
        np.fill_diagonal(apart, -1)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, axis=1)


class State:
    """What the vectors of a block remember."""

    def __init__(self, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        self.near, self.second, self.upper, self.lower = near, second, upper, lower

    @classmethod
    def unknown(cls, n: int, k: int) -> State:
        """Nothing known: bounds that hold of any vector and make each be searched for."""
        second = np.full(n, min(1, k - 1), np.int32)
        return cls(np.zeros(n, np.int32), second, np.full(n, np.inf), np.full(n, -np.inf))

    @classmethod
    def read(cls, data: bytes) -> State:
        n = len(data) // 24
        return cls(
            np.frombuffer(data, "<i4", n).copy(),
            np.frombuffer(data, "<i4", n, 4 * n).copy(),
            np.frombuffer(data, "<f8", n, 8 * n).copy(),
            np.frombuffer(data, "<f8", n, 16 * n).copy(),
        )

    def written(self) -> bytes:
        halves = self.near.astype("<i4"), self.second.astype("<i4"), self.upper.astype("<f8"), self.lower.astype("<f8")
        return b"".join(x.tobytes() for x in halves)


def search(points: np.ndarray, centres: Centres, state: State) -> int:
    """Brings `state` up to date with `centres`; returns the number of distances taken."""
    k = len(centres.parts)
    if k == 1:
        state.near[:], state.second[:] = 0, 0
        return 0
    state.upper = _up(state.upper + centres.moved[state.near])
    state.lower = _down(state.lower - centres.others_moved[state.near])
    at = np.flatnonzero(state.upper >= state.lower)
    if not len(at):
        return 0
    near, second = state.near[at], state.second[at]
    d_near, d_second = _squares(points[at], centres.parts[near]), _squares(points[at], centres.parts[second])
    # From here on the closer of both comes first; among equals the smaller number.
    swap = (d_second < d_near) | ((d_second == d_near) & (second < near))
    near, second = np.where(swap, second, near), np.where(swap, near, second)
    d_near, d_second = np.where(swap, d_second, d_near), np.where(swap, d_near, d_second)
    centre, first, other = near.copy(), np.sqrt(d_near.astype(float)), second.copy()
    taken, open_ = 2 * len(at), np.arange(len(at))
    for step in range(k - 1):
        # Neighbours come by distance, so a vector whose ball ends before this one is done.
        radius = _up(first[open_] + np.sqrt(d_second[open_].astype(float)))
        open_ = open_[centres.apart[centre[open_], step] <= radius]
        if not len(open_):
            break
        found = centres.order[centre[open_], step].astype(np.int32)
        new = found != other[open_]
        where, found = open_[new], found[new]
        d = _squares(points[at[where]], centres.parts[found])
        taken += len(where)
        wins = (d < d_near[where]) | ((d == d_near[where]) & (found < near[where]))
        runs_up = ~wins & ((d < d_second[where]) | ((d == d_second[where]) & (found < second[where])))
        w = where[wins]
        second[w], d_second[w] = near[w], d_near[w]
        near[w], d_near[w] = found[wins], d[wins]
        r = where[runs_up]
        second[r], d_second[r] = found[runs_up], d[runs_up]
    state.near[at], state.second[at] = near, second
    state.upper[at], state.lower[at] = _up(np.sqrt(d_near.astype(float))), _down(np.sqrt(d_second.astype(float)))
    return taken


def _sums(points: np.ndarray, near: np.ndarray) -> list[dict]:
    """For each centroid of a block: how many vectors it has and the sum of their components."""
    order = np.argsort(near, kind="stable")
    names, first = np.unique(near[order], return_index=True)
    totals = np.add.reduceat(points[order], first, axis=0) if len(first) else points[:0]
    counts = np.diff(first, append=len(near))
    return [{"cluster": int(c), "n": int(n), "total": t.tolist()} for c, n, t in zip(names, counts, totals)]


_SUMS = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))


def _blocks(points: DataFrame, dims: int) -> DataFrame:
    """(block, ids, parts): vectors in rows of up to `BLOCK`, as 32-bit integers one after the other."""
    id_type = points.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                data = part.column("parts").flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
                yield pa.record_batch([pa.array([number]), ids, pa.array([data], pa.binary())], ["block", "ids", "parts"])
                number += 1

    return points.mapInArrow(run, f"block bigint, ids array<{id_type}>, parts binary")


class Blocks:
    """The vectors of a run, bucketed by block, so that a round moves bounds to vectors and not the reverse."""

    def __init__(self, points: DataFrame, dims: int) -> None:
        self.spark, self.dims = points.sparkSession, dims
        self.name = f"vulnloom_blocks_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = _blocks(points, dims).repartition(buckets, "block").write.bucketBy(buckets, "block").format("parquet")
        writer.option("path", checkpoint_path(self.spark)).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def round(self, before: DataFrame | None, centres: Broadcast) -> DataFrame:
        """(block, state, sums): the bounds of each block after the search and its sums by centroid."""
        rows = self.table().select("block", "parts")
        rows = rows.withColumn("state", F.lit(None).cast("binary")) if before is None else rows.join(
            before.select("block", "state").hint("shuffle_hash"), "block"
        )
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, parts, data in zip(*(batch.column(c).to_pylist() for c in ("block", "parts", "state"))):
                    points = np.frombuffer(parts, "<i4").reshape(-1, dims).astype(np.int64)
                    state = State.read(data) if data else State.unknown(len(points), len(centres.value.parts))
                    search(points, centres.value, state)
                    columns = [pa.array([block]), pa.array([state.written()], pa.binary()), pa.array([_sums(points, state.near)], _SUMS)]
                    yield pa.record_batch(columns, ["block", "state", "sums"])

        sums = "array<struct<cluster: int, n: bigint, total: array<bigint>>>"
        return rows.mapInArrow(run, f"block bigint, state binary, sums {sums}")

    def assigned(self, states: DataFrame, centres: Broadcast) -> DataFrame:
        """(vec_id, cluster, distance) of each vector."""
        rows = self.table().join(states.select("block", "state").hint("shuffle_hash"), "block").select("ids", "parts", "state")
        dims, id_type = self.dims, self.table().schema["ids"].dataType.elementType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    points = np.frombuffer(batch.column("parts")[i].as_py(), "<i4").reshape(-1, dims).astype(np.int64)
                    near = State.read(batch.column("state")[i].as_py()).near
                    squares = _squares(points, centres.value.parts[near])
                    columns = [batch.column("ids").slice(i, 1).flatten(), pa.array(near, pa.int32()), pa.array(squares, pa.int64())]
                    yield pa.record_batch(columns, ["vec_id", "cluster", "distance"])

        return rows.mapInArrow(run, f"vec_id {id_type}, cluster int, distance bigint")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")


def _means(states: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean; a centroid without vectors stays."""
    each = states.select(F.explode("sums").alias("s")).select("s.cluster", "s.n", F.posexplode("s.total").alias("place", "part"))
    found = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = centres.copy()
    for row in found.collect():
        out[row.cluster, row.place] = row.total // row.n
    return out


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    dims: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(id_col, cluster, distance) of each vector, stored, and the final centroids."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be 1 to {MAX_K}")
    spark = vectors.sparkSession
    points = kept(vectors, dims, id_col, vector_col)
    parts = start(points, k, seed)
    if not len(parts):
        empty = points.limit(0).select(F.col("vec_id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return empty, parts.reshape(0, dims)
    blocks = Blocks(points, dims)
    centres, states = Centres(parts), None
    for i in range(rounds + 1):
        sent = spark.sparkContext.broadcast(centres)
        states = cut(blocks.round(states, sent))
        if i < rounds:
            sent.destroy()
            centres = Centres(_means(states, centres.parts), centres.parts)
    found = cut(blocks.assigned(states, sent))
    sent.destroy()
    blocks.close()
    return found.withColumnRenamed("vec_id", id_col), centres.parts


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """`cluster` with cluster_inertia, inertia and centroid_sha256 beside each vector."""
    found, centres = cluster(vectors, **options)
    # One row for each of at most MAX_K centroids, on the driver and in the broadcast.
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38)")).alias("total")).collect()}
    fits = lambda n: int(n) if n < 1 << 63 else None
    whole = fits(sum(sums.values()))
    hashes = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    rows = [(c, fits(total), whole, hashes[c]) for c, total in sums.items()]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    named = vectors.sparkSession.createDataFrame(rows, schema)
    first = found.columns[0]
    return found.join(F.broadcast(named), "cluster").select(first, "cluster", "distance", *named.columns[1:])
