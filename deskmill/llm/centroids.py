"""Centroid clustering of vectors of whole numbers: Lloyd's rounds with Exponion search (Newling and Fleuret, ICML 2016).

Each vector keeps its centroid, an upper bound on the distance to it and a lower bound on the distance to any other. After centroids have
moved, bounds move with them; a vector whose upper bound is still below the lower one, or below half the distance from its centroid to the
next one, cannot have changed and is not measured. For the others, every centroid that may be nearest or second lies in a ball around the
current centroid, of radius twice the distance to it plus the gap to the next centroid. Each centroid has the others sorted by distance,
so the ball is a prefix of that list. The radius is inclusive and every test strict, so a tie is always seen and goes to the smaller number.

Vectors and their bounds are one table a round, written to the shared folder, so a lost executor costs a re-read. Sums of a cluster are
added up in each task first, so one cluster that holds most vectors makes no large task. Only centroids (``k`` rows) reach the driver and
the tasks.
Distances are whole numbers in 64 bits and exact; bounds are doubles widened beyond their rounding.

Rows: a vector with another number of components, a null or non-finite one, or one that as a whole number exceeds ``LARGEST`` in size (its
distances may not fit 64 bits) is left out. Rows without id are clustered and never start a centroid; a repeated id has a vector for each
row, and its equal hashes are ordered by vector. Fewer vectors than ``k`` give as many centroids. Extra columns are not read. An empty table
or one without any id gives an empty result. A sum of distances beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm import kernels as K
from deskmill.llm.store import cut, drop

LARGEST = 1 << 27
PAIRS = 1 << 16  # distances measured at a time
WIDER, NARROWER = 1 + 1e-12, 1 - 1e-12
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole(rows: DataFrame, size: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of each component x of vectors of ``size`` finite components."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    fits = F.coalesce(F.forall("wide", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= -LARGEST) & (x < LARGEST)), F.lit(False))
    wide_rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), wide.alias("wide"))
    return wide_rows.filter((F.size("wide") == size) & fits).select("vec_id", F.transform("wide", lambda x: F.floor(x).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of 'seed:vec_id', in that order."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id is not null").orderBy(order, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64) if rows else np.empty((0, 0), np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - y
    return np.einsum("ij,ij->i", d, d)


class Neighbours:
    """Centroids with, for each, all of them sorted by distance from it."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        k = len(centroids)
        far = np.sqrt(np.array([squared(centroids, c) for c in centroids], float).reshape(k, k))
        np.fill_diagonal(far, -1.0)  # a centroid comes first in its own list, also among equal ones
        self.order = np.argsort(far, axis=1, kind="stable")
        np.fill_diagonal(far, 0.0)
        self.far = np.take_along_axis(far, self.order, axis=1)
        self.gap = self.far[:, 1] if k > 1 else np.full(k, np.inf)

    def inside(self, cluster: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """How many centroids lie within ``radius`` of each vector's centroid, that one included."""
        out = np.empty(len(cluster), np.int64)
        for c in np.unique(cluster):
            mine = cluster == c
            out[mine] = np.searchsorted(self.far[c], radius[mine], "right")
        return out


def search(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: Neighbours) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, and the distances to it and to the second, of vectors at ``upper`` from the centroid ``cluster``."""
    many = near.inside(cluster, (2 * upper + near.gap[cluster]) * (1 + 1e-9))
    best, first, second = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    edges = np.concatenate(([0], np.cumsum(many)))
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + PAIRS, "right")) - 1)
        row = np.repeat(np.arange(lo, hi), many[lo:hi])
        at = np.arange(len(row)) - np.repeat(edges[lo:hi] - edges[lo], many[lo:hi])
        other = near.order[cluster[row], at]
        d = squared(x[row], near.centroids[other])
        order = np.lexsort((other, d, row))
        start = edges[lo:hi] - edges[lo]
        best[lo:hi], first[lo:hi] = other[order[start]], np.sqrt(d[order[start]])
        two = many[lo:hi] > 1
        second[lo:hi][two] = np.sqrt(d[order[start[two] + 1]])
        lo = hi
    return best, first, second


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, near: Neighbours, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's nearest centroid and its two bounds, after centroid j moved by at most moved[j]."""
    cluster, upper = cluster.copy(), (upper + moved[cluster]) * WIDER
    lower = np.maximum(lower - moved.max(initial=0.0), 0.0) * NARROWER

    def stays(at: np.ndarray) -> np.ndarray:
        return (upper[at] < lower[at]) | (upper[at] < near.gap[cluster[at]] / 2 * NARROWER)

    open_ = np.flatnonzero(~stays(np.arange(len(x))))
    upper[open_] = np.sqrt(squared(x[open_], near.centroids[cluster[open_]])) * WIDER
    open_ = open_[~stays(open_)]
    best, first, second = search(x[open_], cluster[open_], upper[open_], near)
    cluster[open_], upper[open_], lower[open_] = best, first * WIDER, second * NARROWER
    return cluster, upper, lower


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Neighbours(centroids)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), centroids.shape[1])
                own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")]
                cluster, upper, lower = assign(x, own[0].astype(np.int64), own[1], own[2], near, moved)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "upper", "lower"])
        K.release()

    return state.mapInArrow(step, STATE)


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
                d = squared(_matrix(batch.column("v"), centroids.shape[1]), centroids[cluster])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(step, "vec_id long, cluster int, distance long")


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Component-wise floor(sum / count) of each cluster; an empty one keeps its centroid."""
    k, width = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, own = _matrix(batch.column("v"), width), batch.column("cluster").to_numpy(zero_copy_only=False)
            n += np.bincount(own, minlength=k)
            for c in np.unique(own):
                total[c] += x[own == c].sum(axis=0, dtype=np.int64)
        used = np.flatnonzero(n)
        which, at = np.repeat(used, width), np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[which]), pa.array(total[which, at])], ["cluster", "at", "n", "s"])

    sums = state.select("v", "cluster").mapInArrow(add, "cluster int, at int, n long, s long").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for r in sums.collect():  # k * width numbers
        out[r["cluster"], r["at"]] = r["s"] // r["n"]
    return out


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector kept, after ``rounds`` rounds of
    assigning and moving, and a last assignment."""
    spark = rows.sparkSession
    vectors = whole(rows, size, scale, id_col, vector_col)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    # every vector starts at centroid 0, as far away as numbers go, so the first search measures it
    start = vectors.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    state = cut(_assigned(start, centroids, np.zeros(len(centroids))), "clusters")
    for _ in range(rounds):
        after = moved_centroids(state, centroids)
        moved = np.sqrt(squared(after, centroids)) * WIDER
        before, centroids = state, after
        state = cut(_assigned(before, centroids, moved), "clusters")
        drop(before)
    out = _distances(state, centroids)
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = None if None in sums.values() else sum(sums.values())
    total = None if total is None or total >= 1 << 63 else total
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame([(c, s, total, digest[c]) for c, s in sums.items()], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), out["cluster"] == named["c"]).drop("c")  # k rows
