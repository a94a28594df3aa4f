"""Centroid clustering on integers, with a pivot table that spares distances.

Every vector's exact squared distances to a few fixed pivots are computed once and stored with it.
Each round, a centroid's distances to the pivots are taken too; by the triangle inequality the
difference of the two distances to a pivot bounds the distance from below. A vector first meets
the centroid with the least bound, then, in the order of bounds, those whose bound does not exceed
the best exact distance so far. Distances that decide are exact integers; bounds are lowered by
more than their rounding, so ties are never lost.

The driver holds ``k`` centroids and the pivots, never vectors beyond the bounded sample from
which pivots are chosen. A round reads the stored table once and sends sums per task.

Edge cases: vectors of another length, null vectors, and vectors with a null, NaN or infinite
component are left out; fewer vectors than ``k`` make as many clusters; equal vectors and repeated
ids are rows of their own (equal hashes go by components); a null id hashes as the empty text; an
empty table gives no rows; columns that are not named play no part. A scaled component beyond
``LARGEST`` is an error, as squared distances would not fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, bounded_batches

LARGEST = 1 << 27
#: Relative slack of bounds, far above the rounding of a square root and a difference.
SLACK = 1e-9
TABLE = "id long, vector array<int>, pivots array<long>"


def whole(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, all finite."""
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < LARGEST)
    return F.when(fits, floors).otherwise(F.raise_error(F.lit(f"a scaled component beyond {LARGEST}"))).cast("array<int>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column as rows of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(at, pa.array(rows.ravel(), kind))


def squares(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to few points."""
    return np.stack([((vectors - p) ** 2).sum(axis=1) for p in points], axis=1)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Points of the sample, each the farthest from those before; the first is the farthest from the sample's first."""
    picked = [int(squares(sample, sample[:1])[:, 0].argmax())]
    near = squares(sample, sample[picked])[:, 0]
    while len(picked) < n and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, squares(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


def bounds(to_pivots: np.ndarray, centroids_to_pivots: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances: vectors x centroids."""
    v, c = np.sqrt(to_pivots.astype(np.float64)), np.sqrt(centroids_to_pivots.astype(np.float64))
    out = np.zeros((len(v), len(c)))
    for k in range(len(c)):
        gap = np.abs(v - c[k]) - SLACK * (v + c[k])
        out[:, k] = np.maximum(gap, 0).max(axis=1, initial=0) ** 2 * (1 - SLACK)
    return out


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroids_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, exact squared distance, distances computed); the smaller number of equals."""
    n = len(vectors)
    low = bounds(to_pivots, centroids_to_pivots)
    order = np.argsort(low, axis=1, kind="stable")
    cluster, best, computed = np.full(n, len(centroids)), np.full(n, np.iinfo(np.int64).max), 0
    live = np.arange(n)
    for turn in range(len(centroids)):
        at = order[live, turn]
        live = live[low[live, at] <= best[live]]  # bounds only grow from turn to turn
        if not len(live):
            break
        at = order[live, turn]
        d = ((vectors[live] - centroids[at]) ** 2).sum(axis=1)
        computed += len(live)
        better = (d < best[live]) | (d == best[live]) & (at < cluster[live])
        cluster[live[better]], best[live[better]] = at[better], d[better]
    return cluster, best, computed


class Clusters:
    """The rounds over one stored pivot table."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str, k: int, size: int, scale: int, salt: str, n_pivots: int, sample: int):
        self.scratch, self.size = Scratch(vectors.sparkSession), size
        v = F.col(vector_col)
        kept = vectors.filter(whole(v, size)).select(F.col(id_col).cast("long").alias("id"), scaled(v, scale).alias("vector"))
        name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
        first = [np.array(r[0], np.int64) for r in kept.orderBy(name, "vector").select("vector").limit(max(k, sample)).collect()]
        self.centroids = np.array(first[:k], np.int64).reshape(-1, size)
        self.pivots = choose_pivots(np.array(first), n_pivots) if first else np.zeros((0, size), np.int64)
        pivots = self.pivots

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(squares(matrix(b.column(1), size), pivots), pa.int64())], ["id", "vector", "pivots"])

        self.table = self.scratch.save(bounded_batches(kept).mapInArrow(measure, TABLE)) if first else vectors.sparkSession.createDataFrame([], TABLE)

    def assigned(self, emit, schema: str) -> DataFrame:
        """What ``emit`` makes of every batch and its (vectors, clusters, distances)."""
        centroids, size, n_pivots = self.centroids, self.size, len(self.pivots)
        ours = squares(centroids, self.pivots) if len(centroids) else centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(1), size)
                    cluster, distance, _ = nearest(x, matrix(b.column(2), n_pivots), centroids, ours)
                    yield emit(b, x, cluster, distance)

        return bounded_batches(self.table).mapInArrow(run, schema)

    def update(self) -> None:
        """Assigns every vector and moves the centroids that have any to the floors of their means."""
        k, size = self.centroids.shape

        def sums(_, x, cluster, __) -> pa.RecordBatch:
            count = np.bincount(cluster, minlength=k)
            total = np.zeros((k, size), np.int64)
            np.add.at(total, cluster, x)
            own = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own], pa.int64()), lists(total[own], pa.int64())], ["cluster", "n", "total"])

        parts = self.assigned(sums, "cluster int, n long, total array<long>")
        each = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():  # one row per centroid
            self.centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, salt: str = "1:", n_pivots: int = 16, sample: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia and centroid (its final centroid).

    Centroids start as the ``k`` vectors whose ids, behind the salt, have the smallest SHA-256; pivots
    are chosen far from each other among the ``sample`` smallest. ``rounds`` times all vectors are
    assigned and centroids moved, then all are assigned once more.
    """
    work = Clusters(vectors, id_col, vector_col, k, size, scale, salt, n_pivots, sample)
    if len(work.centroids):
        for _ in range(rounds):
            work.update()
    chosen = work.assigned(lambda b, _, at, d: pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(d, pa.int64())], ["id", "cluster", "distance"]), "id long, cluster int, distance long")
    rows = work.scratch.save(chosen)
    sums = {r[0]: int(r[1]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # one row per centroid
    known = [(i, Decimal(sums.get(i, 0)), Decimal(sum(sums.values())), [int(x) for x in c]) for i, c in enumerate(work.centroids)]
    told = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>")
    told = told.withColumns({c: F.col(c).cast("long") for c in ("cluster_inertia", "inertia")})
    return rows.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_text(centroid: Column) -> Column:
    """Components as decimal integers, joined by commas."""
    return F.array_join(F.transform(centroid, lambda x: x.cast("string")), ",")
