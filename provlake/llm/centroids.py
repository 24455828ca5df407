"""Centroid clustering in integers: Lloyd's rounds with bounds, and a shrinking search ball where they fail.

Components become integers floor(SCALE * x). Every vector carries its centroid, the second nearest as it was last seen, an
upper bound of its distance to the one and a lower bound of that to all others. A round moves both bounds by how far the
centroids moved; while the upper one stays below the lower one nothing is compared. Otherwise the distances to the two
remembered centroids are taken, and the search goes through the neighbours of the closer one, nearest first: a centroid
farther from it than the sum of the distances to it and to the second nearest can be neither first nor second, and that
ball shrinks with each find. What remains is compared by exact squared distances, smaller number first; bounds are floats
with a margin and only ever leave out what can't win.

A round is one pass over the vectors (Arrow batches, no shuffle), written to the shared folder with its bounds, and one
partial aggregation of a row for each centroid. The driver holds the centroids only: k rows of `dims` integers.

Defined results: vectors are left out that are null, of another length, or have a component that is null, not finite, or of
LIMIT and more (2^27 after scaling, beyond which a squared distance isn't a long); a null vec_id clusters like any other,
but starts no centroid before all others do; repeated rows count as often as they come, and of rows with one vec_id the
smaller vector comes first as a start; fewer than k vectors make fewer centroids, none an empty table; an inertia beyond a
long is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

K, DIMS, ROUNDS, SEED, SCALE = 16, 64, 3, 1, 64
LIMIT = 1 << 27
#: Share by which bounds are widened before they decide anything; a double's own error is below 1e-15.
MARGIN = 1e-9

_STATE = "vec_id long, v array<int>, near int, second int, upper double, lower double"
_TYPES = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("near", pa.int32()), ("second", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64())])


def integer_vectors(rows: DataFrame, dims: int = DIMS, scale: int = SCALE, embedding: str = "embedding") -> DataFrame:
    """vec_id and v, the scaled integers, of the vectors that can be clustered."""

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < LIMIT)

    kept = rows.where(F.col(embedding).isNotNull() & (F.size(embedding) == dims) & F.forall(embedding, usable))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return kept.select(F.col("vec_id").cast("long"), whole.alias("v"))


def seeds(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order: k rows reach the driver."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v"]
    return np.array([r.v for r in vectors.orderBy(*order).limit(k).collect()], np.int64)


class Ball:
    """The centroids of a round, how far they are from each other, and how far they moved."""

    def __init__(self, centers: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centers = centers
        gaps = np.sqrt(((centers[:, None, :] - centers[None, :, :]) ** 2).sum(2).astype(float))
        np.fill_diagonal(gaps, -1)
        self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        moved = np.zeros(len(centers)) if before is None else np.sqrt(((centers - before) ** 2).sum(1).astype(float))
        self.moved = moved * (1 + MARGIN)
        self.others = np.array([np.delete(self.moved, j).max(initial=0) for j in range(len(centers))])

    def distance(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows to one centroid each."""
        gap = x - self.centers[to]
        return np.einsum("ij,ij->i", gap, gap)

    def assign(self, x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """New near, second, upper and lower."""
        if len(self.centers) == 1:
            return near, second, upper, lower
        near, second = near.copy(), second.copy()
        upper, lower = upper + self.moved[near], lower - self.others[near]
        loose = np.flatnonzero(upper * (1 + MARGIN) >= lower * (1 - MARGIN))
        first = self.distance(x[loose], near[loose])
        upper[loose] = np.sqrt(first.astype(float))
        still = upper[loose] * (1 + MARGIN) >= lower[loose] * (1 - MARGIN)
        loose, first = loose[still], first[still]
        if len(loose):
            near[loose], second[loose], upper[loose], lower[loose] = self.search(x[loose], near[loose], second[loose], first)
        return near, second, upper, lower

    def search(self, x: np.ndarray, one: np.ndarray, two: np.ndarray, d1: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest and second nearest by the neighbours of the closer of two remembered centroids."""
        d2 = self.distance(x, two)
        swap = (d2 < d1) | ((d2 == d1) & (two < one))
        one, two, d1, d2 = np.where(swap, two, one), np.where(swap, one, two), np.where(swap, d2, d1), np.where(swap, d1, d2)
        middle, reach = one.copy(), np.sqrt(d1.astype(float))
        rows = np.arange(len(x))
        for nth in range(self.order.shape[1]):
            ball = (reach[rows] + np.sqrt(d2[rows].astype(float))) * (1 + MARGIN)
            rows = rows[self.gaps[middle[rows], nth] * (1 - MARGIN) <= ball]
            if not len(rows):
                break
            j = self.order[middle[rows], nth]
            d = self.distance(x[rows], j)
            wins = (d < d1[rows]) | ((d == d1[rows]) & (j < one[rows]))
            seconds = ~wins & ((d < d2[rows]) | ((d == d2[rows]) & (j < two[rows])))
            w, s = rows[wins], rows[seconds]
            two[w], d2[w] = one[w], d1[w]
            one[w], d1[w] = j[wins], d[wins]
            two[s], d2[s] = j[seconds], d[seconds]
        return one, two, np.sqrt(d1.astype(float)), np.sqrt(d2.astype(float))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def start(vectors: DataFrame, k: int) -> DataFrame:
    """Vectors with bounds that hold nothing yet."""
    return vectors.select("vec_id", "v", F.lit(0).alias("near"), F.lit(min(1, k - 1)).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))


def assign(state: DataFrame, centers: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """One pass: the state under new centroids, given those that its bounds were made for."""
    dims, made = centers.shape[1], (centers, before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(*made)
        for b in batches:
            if b.num_rows:
                held = (b.column(c).to_numpy(zero_copy_only=False) for c in ("near", "second", "upper", "lower"))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), *(pa.array(a, t) for a, t in zip(ball.assign(_matrix(b, dims), *held), _TYPES.types[2:], strict=True))], schema=_TYPES)

    return state.mapInArrow(run, _STATE)


def distances(state: DataFrame, centers: np.ndarray) -> DataFrame:
    """vec_id, cluster and exact squared distance."""
    dims = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(centers)
        for b in batches:
            if b.num_rows:
                near = b.column("near").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("near"), pa.array(ball.distance(_matrix(b, dims), near))], names=["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def means(state: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean, by exact sums; empty clusters keep their centroid."""
    dims = centers.shape[1]
    rows = state.groupBy("near").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims))).collect()  # a row for each centroid
    moved = centers.copy()
    for r in rows:
        moved[r.near] = [r[f"s{i}"] // r.n for i in range(dims)]
    return moved


def cluster(rows: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) after so many rounds and a last assignment, and the final centroids."""
    vectors = integer_vectors(rows, dims, scale, embedding)
    centers, before = seeds(vectors, k, seed), None
    if not len(centers):
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centers
    state = start(vectors, len(centers))
    for _ in range(rounds):
        held, state = state, materialize(assign(state, centers, before), "vectors")
        if before is not None:
            discard(held)
        before, centers = centers, means(state, centers)
    placed = materialize(distances(assign(state, centers, before), centers), "clusters")
    if rounds:
        discard(state)
    return placed, centers


def with_inertia(placed: DataFrame, centers: np.ndarray) -> DataFrame:
    """placed with cluster_inertia, inertia and centroid_sha256. The joined tables have a row for each centroid."""
    whole = F.sum(F.col("distance").cast("decimal(20,0)"))
    sums = placed.groupBy("cluster").agg(whole.alias("part"))
    total = sums.agg(F.sum("part").alias("all"))
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centers)]
    names = placed.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = names.join(sums, "cluster").join(F.broadcast(total)).select("cluster", F.col("part").try_cast("long").alias("cluster_inertia"), F.col("all").try_cast("long").alias("inertia"), "centroid_sha256")
    return placed.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
