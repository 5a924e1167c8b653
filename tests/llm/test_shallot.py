"""The search against distances to all centroids, and whole runs against plain k-means in Python integers."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from vulnloom.llm import shallot

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, parts string, block string"


def plain(rows, k, rounds, dims, seed=3):
    """Rows of (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), by the contract alone."""
    points = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            points.append((i, tuple(max(-(1 << 27), min(1 << 27, math.floor(1024 * float(np.float32(x))))) for x in v)))
    hashed = sorted((sha256(f"{seed}:{i}".encode()).hexdigest(), p) for i, p in points if i is not None)
    centres = [p for _, p in hashed[:k]]
    if not centres:
        return []

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, p in points:
            groups.setdefault(nearest(p)[1], []).append(p)
        centres = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j])) if j in groups else c for j, c in enumerate(centres)]
    found = [(i, *nearest(p)[::-1]) for i, p in points]
    own = {j: sum(d for _, c, d in found if c == j) for j in range(k)}
    whole = sum(own.values())
    fit = lambda n: n if n < 1 << 63 else None
    named = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, fit(own[c]), fit(whole), named[c]) for i, c, d in found]


def check(spark, rows, k, rounds, dims):
    data = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    found = shallot.clustered(data, k=k, rounds=rounds, dims=dims)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(rows, k, rounds, dims)))


def test_equals_plain_clustering(spark):
    draw = random.Random(1)
    near = [[draw.choice([0, 1, 2]) + draw.gauss(0, 0.2) for _ in range(4)] for _ in range(400)]
    rows = list(enumerate(near))
    rows += [(1000 + i, near[0]) for i in range(200)]  # a group of equal vectors
    rows += [(3, near[3]), (None, near[5]), (None, near[5])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0, None, 1.0, 1.0])]
    rows += [(2004, [1.0, float("nan"), 0.0, 0.0]), (2005, [1.0, float("-inf"), 0.0, 0.0])]
    check(spark, rows, 6, 5, 4)


def test_ties_and_equal_centroids(spark):
    """Small whole numbers: many vectors lie halfway between centroids, and some centroids coincide."""
    draw = random.Random(2)
    rows = [(i, [float(draw.randrange(3)) / 1024 for _ in range(3)]) for i in range(300)]
    check(spark, rows, 9, 4, 3)


def test_edges(spark):
    check(spark, [], 8, 2, 3)
    check(spark, [(1, None), (2, [1.0])], 8, 2, 3)
    check(spark, [(None, [1.0, 2.0, 3.0])], 8, 2, 3)
    check(spark, [(1, [1.0, 2.0, 3.0])], 8, 2, 3)
    check(spark, [(i, [float(i), -2.5, 3.0]) for i in range(5)], 8, 3, 3)
    check(spark, [(i, [3e38 * (-1) ** i, -3e38, i * 1e30]) for i in range(6)], 2, 2, 3)
    with pytest.raises(ValueError, match="k must"):
        shallot.cluster(spark.createDataFrame([], SCHEMA), k=0)


def test_bounds_save_distances():
    """Every round equals the comparison with all centroids, and settled rounds take few distances."""
    draw = np.random.default_rng(4)
    middles = draw.integers(-3000, 3000, (20, 16))
    points = (middles[draw.integers(0, 20, 4000)] + draw.integers(-200, 200, (4000, 16))).astype(np.int64)
    centres, state, taken = shallot.Centres(points[:20].copy()), shallot.State.unknown(4000, 20), []
    for _ in range(12):
        taken.append(shallot.search(points, centres, state))
        state = shallot.State.read(state.written())
        squares = ((points[:, None, :] - centres.parts[None]) ** 2).sum(axis=2)
        assert (state.near == squares.argmin(axis=1)).all()
        assert (state.upper**2 * (1 + 1e-6) + 1e-6 >= squares.min(axis=1)).all()
        means = np.array([points[state.near == j].sum(axis=0) // max(1, (state.near == j).sum()) for j in range(20)])
        centres = shallot.Centres(means, centres.parts)
    assert taken[-1] < 0.05 * 20 * 4000
