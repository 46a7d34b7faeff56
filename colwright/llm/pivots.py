"""Centroid clustering of integer vectors with a table of distances to fixed pivots.

Distances to the pivots (the first centroids) are computed and written once. In every round the
triangle inequality bounds the distance of a vector to a centroid from below by the differences of
their distances to the pivots, so most centroids are dropped without reading a component. The
centroid with the least bound is measured first; the rest only while their bound does not exceed
the best distance so far. Measured distances are exact integers, and ties go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import settings, written

FAST = 1 << 27  # components below this have distances that fit a long, for up to 64 of them
LARGEST = float(1 << 62)  # components from here on have no exact long
SLACK = 1e-9  # share by which bounds are lowered against rounding; they only ever let more through


class Clusters(NamedTuple):
    """rows: the columns of the input's id, cluster, distance (squared); the rest by cluster."""

    rows: DataFrame
    centroids: list[list[int]]
    counts: list[int]


def whole_vectors(vectors: DataFrame, column: str = "embedding", scale: int = 64, dim: int = 64) -> DataFrame:
    """(vec_id, v): vectors of exactly dim components, none null or non-finite, as floor(scale * x).

    Other vectors and those with a component whose floor is no long are left out. Rows that repeat
    an id count each.
    """
    raw = F.transform(F.col(f"`{column}`"), lambda x: x.cast("double") * F.lit(float(scale)))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)
    rows = vectors.select(F.col("`vec_id`").alias("vec_id"), raw.alias("raw"))
    return rows.where((F.size("raw") == dim) & F.forall("raw", fits)).select(
        "vec_id", F.transform("raw", lambda x: F.when(fits(x), F.floor(x)).cast("bigint")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors with the smallest digests of seed and id; ties by components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in rows.orderBy(key.asc_nulls_last(), "v").limit(k).collect()]


def _numbers(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _exactly(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances; Python integers where components are large."""
    gap = v - centres
    return (gap * gap).sum(axis=1)


def _typed(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    small = max(np.abs(v).max(initial=0), np.abs(centres).max(initial=0)) < FAST and v.shape[1] <= 64
    return (v, centres) if small else (v.astype(object), centres.astype(object))


def pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    v, pivots = _typed(v, pivots)
    return np.sqrt(np.stack([_exactly(v, p) for p in pivots], axis=1).astype(np.float64))


def nearest(v: np.ndarray, stored: np.ndarray, centres: np.ndarray,
            gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, distances measured) of each vector.

    stored holds the vectors' distances to the pivots, gaps those of the centroids.
    """
    v, centres = _typed(v, centres)
    low = np.full((len(v), len(centres)), -np.inf)
    for p in range(stored.shape[1]):
        a, b = stored[:, p, None], gaps[None, :, p]
        np.maximum(low, np.abs(a - b) - SLACK * (a + b), out=low)
    label = low.argmin(axis=1)
    best = _exactly(v, centres[label])
    limit = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    measured, started = len(v), label.copy()
    for c in range(len(centres)):
        at = np.flatnonzero((low[:, c] <= limit) & (started != c))
        if not len(at):
            continue
        measured += len(at)
        distance = _exactly(v[at], centres[c])
        better = (distance < best[at]) | ((distance == best[at]) & (c < label[at]))
        at, distance = at[better], distance[better]
        label[at], best[at] = c, distance
        limit[at] = np.sqrt(distance.astype(np.float64)) * (1 + SLACK)
    return label, best, measured


def _measured(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], gaps: np.ndarray):
    centres = np.array(centroids, np.int64)
    for batch in batches:
        if batch.num_rows:
            v = _numbers(batch.column("v"), centres.shape[1])
            stored = _numbers(batch.column("near"), gaps.shape[1])
            yield batch, v, *nearest(v, stored, centres, gaps)


def _moved(table: DataFrame, centroids: list[list[int]], gaps: np.ndarray) -> tuple[list[list[int]], list[int], int]:
    """One round: (new centroids, members, distances measured). A task sends a sum per centroid and
    component; empty centroids stay."""

    def run(batches):
        k, dim = len(centroids), len(centroids[0])
        total = np.zeros((k, dim + 1), object)
        spent = 0
        for _, v, label, _, measured in _measured(batches, centroids, gaps):
            spent += measured
            for c in np.unique(label):
                mine = v[label == c]
                safe = np.abs(mine).max(initial=0) < FAST
                total[c, :dim] += (mine if safe else mine.astype(object)).sum(axis=0).astype(object)
                total[c, dim] += len(mine)
        if spent:
            cluster, place = np.divmod(np.arange(k * (dim + 1)), dim + 1)
            numbers = [Decimal(int(x)) for x in total.ravel()] + [Decimal(spent)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(cluster, -1), pa.int32()), pa.array(np.append(place, 0), pa.int32()),
                 pa.array(numbers, pa.decimal128(38, 0))], names=["cluster", "place", "n"])

    sums = table.mapInArrow(run, "cluster int, place int, n decimal(38,0)").groupBy("cluster", "place").agg(
        F.sum("n").alias("n")).collect()
    found = {(r.cluster, r.place): int(r.n) for r in sums}
    dim = len(centroids[0])
    counts = [found.get((c, dim), 0) for c in range(len(centroids))]
    moved = [[found[c, j] // n for j in range(dim)] if n else old
             for c, (n, old) in enumerate(zip(counts, centroids))]
    return moved, counts, found.get((-1, 0), 0)


def cluster_vectors(vectors: DataFrame, column: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64,
                    dim: int = 64, seed: int = 1, log: list | None = None) -> Clusters:
    """Clusters of the vectors (vec_id, column; other columns are ignored) after so many rounds.

    Vectors are whole_vectors(). Fewer kept vectors than k give as many centroids; an empty table
    gives no rows. A distance that fits no long is null. log receives the distances measured in each
    round. The table of pivot distances is written to the shared folder; the driver holds k vectors.
    """
    rows = whole_vectors(vectors, column, scale, dim)
    centroids = first_centroids(rows, k, seed)
    kind = dict(rows.dtypes)["vec_id"]
    if not centroids:
        empty = vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint")
        return Clusters(empty, [], [])
    pivots = np.array(centroids, np.int64)

    def measure(batches):
        for batch in batches:
            v = _numbers(batch.column("v"), pivots.shape[1])
            near = pivot_distances(v, pivots)
            bounds = pa.array(np.arange(len(v) + 1) * near.shape[1], pa.int32())
            yield batch.append_column("near", pa.ListArray.from_arrays(bounds, pa.array(near.ravel())))

    def assign(batches):
        top = np.iinfo(np.int64).max
        for batch, _, label, distance, _ in _measured(batches, centroids, gaps):
            fits = pa.array([int(x) if x <= top else None for x in distance] if distance.dtype == object else distance, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(label, pa.int32()), fits],
                                             names=["vec_id", "cluster", "distance"])

    with settings(vectors.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="4096"):
        table = written(rows.mapInArrow(measure, f"vec_id {kind}, v array<bigint>, near array<double>"), "pivots")
        for _ in range(rounds):
            gaps = pivot_distances(np.array(centroids, np.int64), pivots)
            centroids, _, spent = _moved(table, centroids, gaps)
            if log is not None:
                log.append(spent)
        gaps = pivot_distances(np.array(centroids, np.int64), pivots)
        assigned = written(table.mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint"), "assigned")
    counts = dict(assigned.groupBy("cluster").count().collect())
    return Clusters(assigned, centroids, [counts.get(c, 0) for c in range(len(centroids))])


def cluster_digests(clusters: Clusters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector; sums
    that fit no long, or hold a distance that fits none, are null."""
    rows = clusters.rows
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r.cluster: r.n for r in rows.groupBy("cluster").agg(whole.alias("n")).collect()}
    long = lambda x: int(x) if x is not None and x < 1 << 63 else None
    total = None if None in sums.values() else sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in clusters.centroids]
    by_cluster = rows.sparkSession.createDataFrame(
        [(c, long(n), long(total), digests[c]) for c, n in sums.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(by_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
