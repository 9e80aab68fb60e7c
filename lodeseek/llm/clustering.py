"""Centroid clustering by sort-means, in exact integers.

Each round orders, for each centroid, the others by their distance from it. A vector's scan begins with the centroid that it had in the round before and
stops where that order goes strictly beyond twice the distance from there: by the triangle inequality no centroid further on is as near. Assignments
are written as a table each round, so that the next one knows where to begin; centroids alone, k rows of them, go through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, finite, materialize

SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: Vectors of a batch that are scanned at once.
AT_ONCE = 4096


def squared(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers, exactly; sizes beyond a long integer are an error."""
    bound = (np.sqrt(np.square(a, dtype=float).sum(1).max(initial=0)) + np.sqrt(np.square(c, dtype=float).sum(1).max(initial=0))) ** 2 * (1 + 1e-6)
    if bound >= 2.0**62:
        raise ValueError("components are so large that squared distances go beyond a long integer")
    if bound < 2.0**53:
        a, c = a.astype(float), c.astype(float)
    return ((a[:, None] - c[None]) ** 2).sum(2).astype(np.int64)


def order_of(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others, nearest first, and their squared distances in that order."""
    apart = squared(centroids, centroids)
    order = np.argsort(apart, axis=1, kind="stable")
    order = np.array([[j for j in row if j != i] for i, row in enumerate(order)], np.int64).reshape(len(centroids), len(centroids) - 1)
    return order, np.take_along_axis(apart, order, 1)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, number of distances computed): the nearest centroid, of equals the smaller number, scanned from the one before.

    D(b, j) > 2 d(x, b) means d(x, j) > d(x, b); squared: D^2 > 4 d^2. What is exactly twice as far is still compared, for a tie.
    """
    cluster, distance, taken = before.copy(), np.empty(len(x), np.int64), len(x)
    for b in np.unique(before):
        mine = np.flatnonzero(before == b)
        first = squared(x[mine], centroids[b : b + 1])[:, 0]
        best, where = first.copy(), np.full(len(mine), b)
        for j, far in zip(order[b], apart[b], strict=True):
            open_ = np.flatnonzero(far / 4 <= first)
            if not len(open_):
                break
            d = squared(x[mine[open_]], centroids[j : j + 1])[:, 0]
            taken += len(open_)
            nearer = (d < best[open_]) | ((d == best[open_]) & (j < where[open_]))
            best[open_[nearer]], where[open_[nearer]] = d[nearer], j
        cluster[mine], distance[mine] = where, best
    return cluster, distance, taken


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (vec_id, x, cluster) with cluster and distance as these centroids give them; materialized."""
    shared = rows.sparkSession.sparkContext.broadcast((centroids, *order_of(centroids)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, order, apart = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(begin, AT_ONCE)
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, centroids.shape[1])
                cluster, distance, _ = assign(x, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), centroids, order, apart)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "x": batch.column("x"), "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)})

    found = rows.select("vec_id", "x", "cluster").mapInArrow(scan, "vec_id long, x array<long>, cluster int, distance long")
    return materialize(found, "assigned")


def _means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors, component by component; empty clusters keep their centroid. k rows come to the driver."""
    sums = [F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    after = centroids.copy()
    for row in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        after[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centroids.shape[1])]
    return after


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", *, size: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> DataFrame:
    """Each vector's cluster: vec_id, cluster, distance (squared, from its final centroid), cluster_inertia, inertia (sums of them), centroid_sha256.

    Vectors are floor(scale * x) in integers. Those of another number of components than `size`, null ones and those with a null or non-finite component
    take no part. Centroids start as the k vectors with least SHA-256 of `seed:vec_id`, of equals the least vector; fewer vectors make fewer centroids. Each
    round assigns all vectors, ties to the smaller number, and moves each centroid that has any to their floored mean; at the end all are assigned once more.

    Every row with a fitting vector gives one row, repeated ids and rows too; a null id stays null and starts a centroid only after all others. An empty table
    gives an empty one. Sums beyond a long integer are an error. Other columns aren't used, whatever their names.
    """
    spark = df.sparkSession
    rows = df.select(column(vec_id).cast("long").alias("vec_id"), column(vector).cast("array<double>").alias("x"))
    rows = rows.where(finite(F.col("x")) & (F.size("x") == size)).select("vec_id", F.transform("x", lambda v: F.floor(scale * v)).alias("x"), F.lit(0).alias("cluster"))
    now = materialize(rows, "vectors")
    first = now.select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], SCHEMA)
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), size)
    for _ in range(rounds):
        after = _assigned(now, centroids)
        discard(now)
        now, centroids = after, _means(after, centroids)
    final = _assigned(now, centroids)
    discard(now)
    sums = {r["cluster"]: int(r["d"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(i, sums[i], digests[i]) for i in sorted(sums)], "cluster int, cluster_inertia long, centroid_sha256 string")
    total = F.lit(sum(sums.values())).cast("long").alias("inertia")
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total, "centroid_sha256")
