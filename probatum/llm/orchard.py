"""Centroid clustering by Orchard search, in exact integers.

A vector walks the list of its current centroid's neighbours, nearest first.  It jumps to
the list of a closer centroid as soon as it finds one, tests no centroid twice, and stops
where the neighbours are strictly beyond twice its own distance: by the triangle inequality
none of the rest is as near.  Rounds are passes over one written table; tasks hand on their
sums per centroid alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.shared import scope, written

DIMS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: vectors that are searched for at once
BLOCK = 4096


def reach(dims: int) -> int:
    """The largest component for which four times a squared distance fits a long."""
    return isqrt((1 << 61) // dims) // 2


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the whole vectors as integers floor(scale * x).

    Kept are vectors of exactly ``dims`` components, none null, NaN, infinite, or so large
    that squared distances would not fit a long.
    """
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fits = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < reach(dims) / scale), F.lit(False)))
    return (df.where(F.coalesce((F.size(vector) == dims) & fits, F.lit(False)))
            .select(F.col(vec_id).alias("vec_id"), F.transform(scaled, lambda x: x.cast("int")).alias("v")))


class Search:
    """Nearest centroids; of equally near ones the smallest number."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, -1)  # a centroid heads its own list, which leaves it out
        self.near = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.near, axis=1)

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance, for every row."""
        n, k = len(points), len(self.centroids)
        now, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        best = ((points - self.centroids[0]) ** 2).sum(axis=1)
        tested = np.zeros((n, k), dtype=bool)
        tested[:, 0] = True
        live = np.arange(n if k > 1 else 0)
        while len(live):
            there = self.near[now[live], at[live]]
            ends = self.apart[now[live], at[live]] > 4 * best[live]
            live, there = live[~ends], there[~ends]
            at[live] += 1
            new = ~tested[live, there]
            who, other = live[new], there[new]
            tested[who, other] = True
            distance = ((points[who] - self.centroids[other]) ** 2).sum(axis=1)
            closer = (distance < best[who]) | ((distance == best[who]) & (other < now[who]))
            jumps = who[closer]
            now[jumps], best[jumps], at[jumps] = other[closer], distance[closer], 0
            live = live[at[live] < k - 1]
        return now, best


def _points(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _summed(search: Search):
    """Each task's sums and counts per centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(search.centroids), np.zeros(len(search.centroids), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                points = _points(batch.column("v").slice(start, BLOCK))
                cluster, _ = search(points)
                counts += np.bincount(cluster, minlength=len(counts))
                np.add.at(sums, cluster, points)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(len(counts)), pa.int32()), "n": counts,
                                          "sums": pa.array(list(sums), pa.list_(pa.int64()))})
    return run


def _assigned(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                cluster, distance = search(_points(part.column("v")))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                                 names=["vec_id", "cluster", "distance"])
    return run


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ``seed:vec_id`` has the smallest hashes, in their order; all where there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.orderBy(key, "v").limit(k).collect()], dtype=np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid that vectors are nearest to becomes their componentwise floor of the mean."""
    parts = vectors.select("v").mapInArrow(_summed(Search(centroids)), "cluster int, n bigint, sums array<bigint>").where("n > 0")
    # cells of all centroids: as many rows as the centroids have components
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in cells.collect():
        out[r.cluster, r.at] = r.s // r.n
    return out


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, k: int = CENTROIDS,
            rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every kept vector.

    Vectors with nulls, non-finite components or another length are left out (see
    ``integer_vectors``).  Repeated rows count as often as they come; a null id is the
    empty text in the order of the first centroids, equal ids run by their components.
    Centroids that no vector is nearest to stay where they are; ties go to the smaller
    number.  An inertia beyond a long is null.  An empty table gives no rows; further
    columns are not read.
    """
    spark, kind = df.sparkSession, df.schema[vec_id].dataType.simpleString()
    with scope(spark) as tables:
        vectors = written(integer_vectors(df, vec_id, vector, dims, scale), "vectors")
        centroids = seeds(vectors, k, seed)
        if not len(centroids):
            return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        for _ in range(rounds):
            centroids = moved(vectors, centroids)
        found = written(vectors.mapInArrow(_assigned(Search(centroids)), f"vec_id {kind}, cluster int, distance bigint"), "assigned")
        tables.keep(found)
        totals = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    whole = sum(totals.values()) if None not in totals.values() else None
    rows = [(c, s, whole if whole is not None and whole < 1 << 63 else None, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
            for c, s in totals.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # a row per centroid
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
