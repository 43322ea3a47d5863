"""Centroid clustering: plain Lloyd rounds in exact integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import load, stash

SCALE, CLUSTERS, ROUNDS, SEED = 1024, 8, 10, 3
#: Differences of components below this can be squared and summed over 64 components in 64 bits.
PLAIN = 1 << 27
MOST = (1 << 63) - 1


def grid(vectors: DataFrame, dim: int, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, for vectors of ``dim`` components that are all finite.

    Null vectors and those with a null, an infinite or no number, of another size, or with a
    component that no 63-bit integer holds, are left out. Repeated rows and equal or null ids stay.
    """
    x = F.transform("embedding", lambda c: scale * c.cast("double"))
    fits = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(1 << 62)), F.lit(False)))
    kept = vectors.select("vec_id", x.alias("x")).where((F.size("x") == dim) & fits)
    return kept.select("vec_id", F.transform("x", lambda c: F.floor(c)).alias("v"))


def first_centroids(points: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, null ids last; equal ids are in order of their components. Fewer, if there are no more."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in points.orderBy(order.asc_nulls_last(), "v").limit(clusters).collect()]


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The centroid of least squared distance of each row of integers, the first of equal ones, and that distance."""
    c = np.array(centroids, np.int64)
    if np.abs(v).max(initial=0) >= PLAIN or np.abs(c).max() >= PLAIN or v.shape[1] > 64:
        v, c = v.astype(object), c.astype(object)  # unbounded integers
    distance = np.stack([((v - one) ** 2).sum(1) for one in c], 1)
    which = np.argmin(distance, 1)
    return which, distance[np.arange(len(v)), which]


def next_centroids(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the means of each centroid's vectors; one without vectors stays.

    A task sums its vectors; a row for each centroid and component of each task is shuffled, and
    as many rows as the centroids have components reach the driver.
    """
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = shared.value
        k, dim = len(centroids), len(centroids[0])
        total, count = [[0] * dim for _ in range(k)], [0] * k
        for frame in frames:
            if not len(frame):
                continue
            v = np.stack(frame["v"].to_numpy()).astype(np.int64)
            which, _ = nearest(v, centroids)
            small = np.abs(v).max() < (1 << 62) // len(v)
            for i in np.unique(which).tolist():
                mine = v[which == i]
                count[i] += len(mine)
                total[i] = [a + int(b) for a, b in zip(total[i], (mine if small else mine.astype(object)).sum(0))]
        rows = [(i, j, str(total[i][j]), count[i]) for i in range(k) for j in range(dim) if count[i]]
        yield pd.DataFrame(rows, columns=["cluster", "component", "total", "n"])

    parts = points.select("v").mapInPandas(sums, "cluster int, component int, total string, n long")
    merged = parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = [list(c) for c in centroids]
    for r in merged.collect():
        out[r["cluster"]][r["component"]] = int(r["total"]) // r["n"]
    shared.destroy()
    return out


def lloyd(points: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """The centroids after all rounds; none for an empty table."""
    centroids = first_centroids(points, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(points, centroids)
    return centroids


def assigned(points: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and distance of every vector. A squared distance beyond 63 bits is given as the greatest such number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                which, distance = nearest(np.stack(frame["v"].to_numpy()).astype(np.int64), centroids)
                yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": which.astype(np.int32), "distance": np.array([min(MOST, int(d)) for d in distance], np.int64)})

    return points.mapInPandas(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, dim: int = 64, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, centroid (array), cluster_inertia and inertia of every vector that ``grid`` keeps.

    Each round reads all vectors once, in place; none is shuffled. Other columns, whatever their
    names, are not read. An empty table gives none.
    """
    spark = vectors.sparkSession
    points = stash(grid(vectors.withColumn("vec_id", F.col("vec_id").cast("long")), dim), "cluster-points", small=True)
    centroids = lloyd(points, clusters, rounds, seed)
    found = stash(assigned(points, centroids), "cluster-of", small=True) if centroids else assigned(points.where(F.lit(False)), [[0] * dim])
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(MOST, sum(inertia.values()))
    rows = [(i, [int(x) for x in c], min(MOST, inertia.get(i, 0)), total) for i, c in enumerate(centroids)]
    ends = spark.createDataFrame(rows, "cluster int, centroid array<long>, cluster_inertia long, inertia long")
    return found.join(F.broadcast(ends), "cluster")  # a row for each of the stated number of clusters


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(load(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
