"""Clustering beside plain Lloyd rounds over Python integers."""

import hashlib
import random

import numpy as np
import pytest
from test_operators import shipped  # noqa: F401

from provlake.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, near string, v int, cluster int"


def plain(vectors, k, dims, rounds, seed=1):
    """vectors: (vec_id, integers). Every vector against every centroid."""
    name = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centers = [v for i, v in sorted(vectors, key=lambda r: (name(r[0]) if r[0] is not None else (True, ""), r[1]))[:k]]
    for step in range(rounds + 1):
        at = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers)) for _, v in vectors]
        if step < rounds:
            for j in range(len(centers)):
                mine = [v for (_, v), (_, c) in zip(vectors, at) if c == j]
                if mine:
                    centers[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, j, d) for (i, _), (d, j) in zip(vectors, at)], centers


@pytest.mark.parametrize("shape", ["spread", "grid", "one", "far"])
def test_rounds(spark, shape):
    """Well apart, full of ties, all equal, and at the limit of the integers; in few dimensions, so that bounds matter."""
    r = random.Random(shape)
    draw = {"spread": lambda: r.gauss(0, 3), "grid": lambda: float(r.randrange(3)), "one": lambda: 0.5, "far": lambda: r.choice([-1, 1]) * 2.0**20}[shape]
    rows = [(i % 190, [draw() for _ in range(3)]) for i in range(300)] + [(None, [draw() for _ in range(3)])] * 2
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(5)
    for k, rounds in ((16, 3), (7, 6), (1, 2), (400, 1), (5, 0)):
        placed, centers = centroids.cluster(frame, k, 3, rounds)
        as_float = [(i, np.floor(np.array(v, np.float32).astype(float) * 64).astype(int).tolist()) for i, v in rows]
        want, final = plain(as_float, k, 3, rounds)
        assert sorted(map(repr, (tuple(x) for x in placed.collect()))) == sorted(map(repr, want)) and centers.tolist() == final


def test_bounds_leave_out_comparisons():
    """With centroids that hardly move, most vectors keep their centroid unseen, and a search looks at few centroids."""
    g = np.random.default_rng(5)
    centers = g.integers(-4000, 4000, (64, 8))
    x = centers[g.integers(0, 64, 4000)] + g.integers(-60, 60, (4000, 8))
    ball = centroids.Ball(centers)
    state = ball.assign(x, np.zeros(4000, int), np.ones(4000, int), np.full(4000, np.inf), np.zeros(4000))
    moved = centroids.Ball(centers + 1, centers)
    seen = []
    moved.distance = lambda a, b: seen.append(len(a)) or centroids.Ball.distance(moved, a, b)
    again = moved.assign(x, *state)
    exact = ((x[:, None] - (centers + 1)[None]) ** 2).sum(2)
    assert (again[0] == exact.argmin(1)).all() and sum(seen) < 4000
    assert (again[2] >= np.sqrt(exact.min(1)) * (1 - 1e-9)).all() and (again[3] <= np.sqrt(np.partition(exact, 1, 1)[:, 1]) * (1 + 1e-9)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, [3e38, 0.0, 0.0]), (8, [0.1, -0.1, 2.0]), (None, [0.1, -0.1, 2.0])]
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    got = centroids.with_inertia(*centroids.cluster(frame, 4, 3)).collect()
    want = hashlib.sha256(b"6,-7,128").hexdigest()
    assert sorted((r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == [(0, 0, 0, 0, 0, want), (8, 0, 0, 0, 0, want)]
    assert centroids.with_inertia(*centroids.cluster(frame.limit(0), 4, 3)).collect() == []
