"""Orchard clustering against plain rounds in Python integers."""

import hashlib
import math
import random

import numpy as np

from probatum.llm import orchard

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, v int"


def plain(rows, dims, k, rounds):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            if mine := [v for (_, v), c in zip(kept, own) if c == n]:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [nearest(v) for _, v in kept]
    inertia = {n: sum(d for d, c in found if c == n) for _, n in found}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(kept, found)), key=str)


def vectors(dims):
    draw = random.Random(2)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5, 1.0]) + draw.randrange(3) / 1024 for _ in range(dims)], "x", 0) for i in range(150)]
    rows += [rows[3], rows[3], (None, rows[5][1], None, 1), (200, None, "", 2), (201, [1.0] * (dims - 1), "", 3), (202, [], "", 3),
             (203, [None] + [1.0] * (dims - 1), "", 4), (204, [float("nan")] * dims, "", 5), (205, [float("-inf")] * dims, "", 6)]
    return rows


def test_against_plain_rounds(spark):
    for dims, k, rounds in ((64, 8, 4), (3, 5, 6), (2, 1, 2)):
        rows = vectors(dims)
        got = orchard.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), dims=dims, k=k, rounds=rounds)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, dims, k, rounds)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(4)[:3]
    assert sorted(map(tuple, orchard.cluster(spark.createDataFrame(rows, SCHEMA), dims=4).collect()), key=str) == plain(rows, 4, 8, 10)
    assert orchard.cluster(spark.createDataFrame([], SCHEMA)).collect() == []


def test_search_finds_the_first_of_the_nearest():
    draw = np.random.default_rng(5)
    for k in (1, 2, 7, 40):
        centroids = draw.integers(-3, 4, size=(k, 4))
        centroids[k // 2] = centroids[0]  # equal centroids: the smaller number
        points = draw.integers(-4, 5, size=(500, 4))
        cluster, distance = orchard.Search(centroids)(points)
        every = ((points[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_components_too_large_for_a_long_are_left_out(spark):
    rows = [(1, [3e38] * 4, "", 0), (2, [1.0] * 4, "", 0)]
    assert [r.vec_id for r in orchard.cluster(spark.createDataFrame(rows, SCHEMA), dims=4).collect()] == [2]
