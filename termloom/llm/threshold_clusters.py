"""Centroid clustering, each vector's nearest centroid found by the threshold algorithm.

Every dimension has a list of the centroids, sorted by their component there. From a vector's own value each list is
walked outward, nearest first; a centroid met for the first time gets its exact distance. What no list has shown yet is at
least as far as the sum of the lists' frontiers, so a vector is done when that sum is strictly over its best exact
distance: ties are then settled too. Components are integers, all sums are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Components are under this in magnitude, so that a squared distance over up to 128 dimensions fits into 64 bits.
COMPONENT_LIMIT = 1 << 27
#: Vectors that are walked together.
ROWS = 1024
FAR = np.iinfo(np.int64).max


class SortedLists:
    """The centroids [k, dimensions] and, by dimension, their components in ascending order with the centroids' numbers."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        order = np.argsort(centroids, axis=0, kind="stable")
        self.number, self.value = order.T.copy(), np.take_along_axis(centroids, order, 0).T.copy()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row (ties: smaller number), and the depth at which its walk stopped."""
        (n, d), k = x.shape, len(self.centroids)
        dims, rows = np.arange(d), np.arange(n)
        right = (self.value[None, :, :] < x[:, :, None]).sum(2)  # the first one at or over the vector's value
        left = right - 1
        exact = np.full((n, k), FAR)
        depth, live = np.full(n, k), rows
        for step in range(1, k + 1):
            own, a, b = x[live], left[live], right[live]
            down = np.where(a >= 0, own - self.value[dims, np.maximum(a, 0)], FAR)
            up = np.where(b < k, self.value[dims, np.minimum(b, k - 1)] - own, FAR)
            lower = down <= up
            met = np.zeros((len(live), k), bool)
            met[np.arange(len(live))[:, None], self.number[dims, np.where(lower, a, b)]] = True
            left[live], right[live] = a - lower, b + ~lower
            i, c = np.nonzero(met & (exact[live] == FAR))
            apart = own[i] - self.centroids[c]
            exact[live[i], c] = np.einsum("ij,ij->i", apart, apart)
            frontier = np.minimum(down, up)
            done = np.einsum("ij,ij->i", frontier, frontier) > exact[live].min(1)
            depth[live[done]] = step
            live = live[~done]
            if not len(live):
                break
        best = exact.argmin(1)  # the first of equal ones
        return best, exact[rows, best], depth


def _whole(x: np.ndarray) -> int:
    """The exact sum of non-negative 64-bit numbers."""
    return (int((x >> 32).sum()) << 32) + int((x & 0xFFFFFFFF).sum())


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each of ``vectors`` (vec_id, embedding) that is kept.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite, as integers floor(scale * component);
    one that is 2^27 or more in magnitude is an error, as its distances may not fit into a long. The first centroids are
    the k kept vectors with the least sha256 of ``seed:vec_id`` (rows of equal or null ids by their components, null ids
    last). Each round assigns all vectors and moves every centroid that has some to the floor of their mean; then all are
    assigned once more. Repeated rows are vectors of their own; with fewer than k vectors there are fewer centroids, with
    none no rows. Other columns are ignored.

    A round is one scan: a task gives a sum for each centroid and dimension, and only these sums, k * (dimensions + 1) of
    them, reach the driver.
    """
    if dimensions > 128:
        raise ValueError("squared distances over more than 128 dimensions may not fit into a long")
    finite = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    # size() of a null array is null or -1, by setting: neither is dimensions
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == dimensions) & finite)
    hashed, = fresh(kept, "hash")
    first = kept.withColumn(hashed, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col(hashed).asc_nulls_last(), "embedding").limit(k)
    drawn = first.select("embedding").collect()
    id_type = kept.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not drawn:
        return kept.sparkSession.createDataFrame([], out)

    def whole(x: np.ndarray) -> np.ndarray:
        scaled = np.floor(scale * x.reshape(-1, dimensions))
        if len(scaled) and np.abs(scaled).max() >= COMPONENT_LIMIT:
            raise ValueError(f"a component, times {scale}, is {COMPONENT_LIMIT} or more in magnitude")
        return scaled.astype(np.int64)

    def blocks(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(0, len(b), ROWS):
            yield i, whole(b.column("embedding").slice(i, ROWS).flatten().to_numpy(zero_copy_only=False))

    def totals(lists: SortedLists):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, count, spread = np.zeros((len(lists.centroids), dimensions), np.int64), np.zeros(len(lists.centroids), np.int64), {}
            for b in batches:
                for _, x in blocks(b):
                    near, distance, _ = lists.nearest(x)
                    for c in np.unique(near):
                        own = near == c
                        sums[c] += x[own].sum(0)
                        count[c] += own.sum()
                        spread[c] = spread.get(c, 0) + _whole(distance[own])
            for c in spread:
                values = [Decimal(int(v)) for v in sums[c]] + [Decimal(spread[c])]
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()),
                    pa.array(values, pa.decimal128(38, 0)), pa.array([count[c]] * len(values), pa.int64())], ["cluster", "place", "total", "n"])

        found = kept.mapInArrow(run, "cluster int, place int, total decimal(38,0), n long").groupBy("cluster", "place")
        return {(r["cluster"], r["place"]): (int(r["total"]), r["n"]) for r in found.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}

    centroids = whole(np.array([r["embedding"] for r in drawn], np.float64))
    for _ in range(rounds):
        found = totals(SortedLists(centroids))
        for (c, place), (total, n) in found.items():
            if place < dimensions:
                centroids[c, place] = total // n
    lists = SortedLists(centroids)
    inertia = {c: total for (c, place), (total, _) in totals(lists).items() if place == dimensions}
    own_inertia = [inertia.get(c, 0) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in blocks(b):
                near, distance, _ = lists.nearest(x)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").slice(i, len(x)), pa.array(near, pa.int32()), pa.array(distance),
                    pa.array(own_inertia, pa.int64()).take(pa.array(near)), pa.array([sum(own_inertia)] * len(x), pa.int64()), pa.array(names).take(pa.array(near))],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return kept.mapInArrow(assigned, out)
