"""Connected components of a graph given by edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.shared import release, written

#: edges that a task turns into stars at a time
CHUNK = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with an edge down has that one alone, to a node that has none: then all point to the smallest."""
    ends = edges.select("u", F.lit(1).alias("down"), (F.col("v") >= F.col("u")).cast("int").alias("wrong")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(0).alias("wrong")))
    nodes = ends.groupBy("u").agg(F.sum("down").alias("down"), F.count_if(F.col("down") == 0).alias("up"), F.max("wrong").alias("wrong"))
    return nodes.where("down > 1 OR (down > 0 AND up > 0) OR wrong > 0").isEmpty()


def _forest(edges: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The smallest node that each node reaches by these edges."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]  # half the way for the next
        return x

    for u, v in edges:
        u, v = top(u), top(v)
        up[max(u, v)] = min(u, v)
    return {x: top(x) for x in up}


def _chunk_stars(edges: DataFrame, chunk: int) -> DataFrame:
    """Edges that connect the same nodes: of every ``chunk`` edges of a task, the stars of their own components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            forest = _forest(zip(table["u"].to_pylist(), table["v"].to_pylist()))
            below = [(u, v) for u, v in forest.items() if u != v]
            return pa.RecordBatch.from_arrays(list(map(pa.array, np.array(below, dtype=np.int64).reshape(-1, 2).T.copy())), names=["u", "v"])

        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                held.append(batch.slice(start, chunk))
                if sum(b.num_rows for b in held) >= chunk:
                    yield stars()
                    held.clear()
        if held:
            yield stars()
    return edges.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(u, root)`` for every node of ``edges(u, v)`` but the roots: the smallest node it reaches.

    Tasks turn chunks of the edges into stars first; a graph of one chunk is done by then.
    Else stars follow in turns, until all components are stars: a number of rounds that grows with the logarithm
    of the component's size.  A node's neighbours are never gathered in one place; the
    joins on a node with very many neighbours can be split.
    """
    given = written(edges.select("u", "v").where("u <> v"), "edges")
    n = given.count()
    if n == 0:
        return given.select("u", F.col("v").alias("root"))
    now = written(_chunk_stars(given.coalesce(max(1, n // chunk)), chunk), "edges")
    release(given)
    while n >= chunk and not _are_stars(now):
        last = now
        now = written(_small_star(_large_star(now)), "edges")
        release(last)
    return now.select("u", F.col("v").alias("root"))


def extended(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components ``roots(u, root)`` after further ``edges(u, v)``.

    Only edges between two components take part, as edges between their smallest nodes, so
    what is known already is not worked out anew.  Without ``roots`` the edges are all there is.
    """
    if roots is None:
        return components(edges)
    moved = components(across(edges.select("u", "v"), roots).select(F.col("u_root").alias("u"), F.col("v_root").alias("v")))
    if moved.isEmpty():
        return roots
    to = moved.select(F.col("u").alias("root"), F.col("root").alias("to"))
    now = roots.join(to, "root", "left").select("u", F.coalesce("to", "root").alias("root"))
    return written(now.unionByName(moved), "roots")


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v, …)`` whose ends lie in different components, with ``u_root`` and ``v_root``."""
    u, v = (roots.select(F.col("u").alias(x), F.col("root").alias(f"{x}_root")) for x in "uv")
    rooted = pairs.join(u, "u", "left").join(v, "v", "left")
    return rooted.withColumns({f"{x}_root": F.coalesce(f"{x}_root", x) for x in "uv"}).where("u_root <> v_root")


def least_rows(rows: DataFrame) -> DataFrame:
    """``row``: of ``rows(row, doc_id, root)`` one per root, the smallest row of the smallest id; null ids come last."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    return rows.groupBy("root").agg(F.min(place).alias("least")).select("least.row")
