"""Centroid clustering of integer vectors with an equal-average equal-variance search for the nearest centroid.

For vectors x and c of n components, with sums S and deviations V = sqrt(sum of (component - mean)^2), the squared distance is at least
(S_x - S_c)^2 / n + (V_x - V_c)^2. Centroids stand in order of their sums. A vector is placed among them by its own sum and looks outward,
always at the nearer side: a side ends where the first term alone exceeds the least distance so far, and a centroid is passed over where
both terms do. Only what is left is compared in full, in integers. Bounds are taken a little too low, so rounding rejects nothing wrongly.

A round is one pass over the table in which each task sums its own vectors by centroid; the sums of tasks are added by Spark, and only
the centroids (their number times the components) come to the driver and go out with the next pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspark.llm.common import saved

#: The largest integer component: sums of squared differences of up to 512 components then fit 64 bits.
LARGEST = 1 << 26
#: By this share bounds are lowered before they reject.
SLACK = 1e-9


class Search:
    """The nearest of some centroids (an integer matrix), the least number among equal distances."""

    def __init__(self, centroids: np.ndarray):
        self.n = centroids.shape[1]
        sums = centroids.sum(1)
        self.order = np.lexsort((np.arange(len(sums)), sums))
        self.centroids, self.sums = centroids[self.order], sums[self.order]
        self.deviations = self.deviation(self.centroids)
        self.compared = 0

    @staticmethod
    def deviation(vectors: np.ndarray) -> np.ndarray:
        x = vectors.astype(np.float64)
        return np.sqrt(((x - x.mean(1, keepdims=True)) ** 2).sum(1))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid number and squared distance of each row."""
        rows, k = len(vectors), len(self.order)
        sums, deviations = vectors.sum(1), self.deviation(vectors)
        best = np.full(rows, np.iinfo(np.int64).max)
        found = np.full(rows, k, np.int64)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        looking = np.arange(rows)
        while len(looking):
            s, lo, hi = sums[looking], left[looking], right[looking]
            below = np.where(lo >= 0, s - self.sums[np.maximum(lo, 0)], np.iinfo(np.int64).max)
            above = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - s, np.iinfo(np.int64).max)
            at = np.where(below <= above, lo, hi)
            gap = np.minimum(below, above).astype(np.float64)
            by_mean = gap * gap / self.n * (1 - SLACK)
            going = ((lo >= 0) | (hi < k)) & (by_mean <= best[looking])  # else all that is left lies farther by its mean
            looking, at, by_mean, from_left = looking[going], at[going], by_mean[going], (below <= above)[going]
            left[looking[from_left]] -= 1
            right[looking[~from_left]] += 1
            apart = np.abs(deviations[looking] - self.deviations[at]) - SLACK * (deviations[looking] + self.deviations[at])
            left_over = by_mean + np.maximum(apart, 0) ** 2 * (1 - SLACK) <= best[looking]
            who, which = looking[left_over], at[left_over]
            self.compared += len(who)
            distance = ((vectors[who] - self.centroids[which]) ** 2).sum(1)
            number = self.order[which]
            better = (distance < best[who]) | ((distance == best[who]) & (number < found[who]))
            best[who[better]], found[who[better]] = distance[better], number[better]
        return found, best


def integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * component) of the lists that have `width` components, none null or non-finite, and which rows these are.

    A vector with an integer beyond LARGEST in size is not among them.
    """
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * float(scale))
        fit = (np.isfinite(scaled) & (np.abs(scaled) <= LARGEST)).all(1)
    return scaled[fit].astype(np.int64), rows[fit]


def first_centroids(vectors: DataFrame, key: str, vector: str, k: int, width: int, scale: int, seed: int) -> np.ndarray:
    """The k kept vectors whose hex sha256 of `seed:key` is least, in that order; fewer if fewer are kept."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = integers(batch.column(1), width, scale)
            if len(rows):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], ["digest", "own"])

    rows = vectors.select(digest.alias("digest"), F.col(vector)).mapInArrow(kept, "digest string, own array<long>")
    picked = rows.orderBy("digest", "own").limit(k).collect()
    return np.array([r.own for r in picked], np.int64).reshape(-1, width)


def moved(vectors: DataFrame, vector: str, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: each the floor of the mean of its vectors, one without any as it was."""
    k, width = centroids.shape

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            own, _ = integers(batch.column(0), width, scale)
            number, _ = search.nearest(own)
            counts = np.bincount(number, minlength=k)
            met = np.flatnonzero(counts)
            sums = np.zeros((k, width), np.int64)
            np.add.at(sums, number, own)
            columns = [pa.array(np.repeat(met, width)), pa.array(np.tile(np.arange(width), len(met))), pa.array(np.repeat(counts[met], width)), pa.array(sums[met].ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["number", "component", "rows", "total"])

    parts = vectors.select(vector).mapInArrow(tally, "number long, component long, rows long, total long")
    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    out = centroids.copy()
    for r in parts.groupBy("number", "component").agg(F.sum("rows").alias("rows"), exact.alias("total")).collect():
        out[r.number, r.component] = int(r.total) // r.rows
    return out


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, width: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(key, cluster, distance) of every vector kept, and (cluster, centroid array<long>) after `rounds` rounds.

    Kept is a vector with exactly `width` components, none null or non-finite; component x becomes floor(scale * x), x as double. One
    whose integer would exceed LARGEST in size is not kept either. Repeated rows are each assigned; a null key is an empty one to the
    first choice of centroids. Equal distances: the smaller number. With fewer than k vectors there are fewer centroids, with none
    both results are empty. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType
    centroids = first_centroids(vectors, key, vector, k, width, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, vector, centroids, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids) if len(centroids) else None
        for batch in batches:
            own, rows = integers(batch.column(1), width, scale)
            if search and len(rows):
                number, distance = search.nearest(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(number.astype(np.int32)), pa.array(distance)], [key, "cluster", "distance"])

    out = vectors.select(F.col(key), F.col(vector)).mapInArrow(assign, f"`{key}` {kind.simpleString()}, cluster int, distance long")
    table = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    return out, table


def with_inertia(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """assigned with cluster_inertia, inertia (distances summed over the cluster and over all) and centroid_sha256 (of the components,
    joined by commas). Sums are exact; one beyond 64 bits is null.

    The assignment is written once to the shared folder; what is joined has one row a cluster.
    """
    assigned = saved(assigned)
    by_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    whole = sum((r.total for r in by_cluster), Decimal(0))
    sums = assigned.sparkSession.createDataFrame([(r.cluster, r.total, whole) for r in by_cluster], "cluster int, own decimal(38,0), whole decimal(38,0)")
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string"))), 256)
    facts = centroids.join(sums, "cluster").select("cluster", F.col("own").try_cast("long").alias("cluster_inertia"), F.col("whole").try_cast("long").alias("inertia"), digest.alias("centroid_sha256"))
    return assigned.join(F.broadcast(facts), "cluster")
