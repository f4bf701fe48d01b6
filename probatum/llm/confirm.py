"""Candidate pairs of texts checked on their full sets of word shingles.

A pair's texts travel to be compared, so few pairs are checked first: for each text its
likeliest partner and its smallest.  What these link needs no further check among itself;
the other pairs follow once it is known which of them lie in different components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.components import across, extended
from probatum.llm.packs import hand_back_memory
from probatum.llm.shared import written


def checked(pairs: DataFrame, texts: DataFrame, shingles: Callable[[str | None], np.ndarray], alike: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """Those of ``pairs(u, v)`` whose ``texts(row, text)`` are alike, as edges ``(u, v)``."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for v, a, b in zip(batch.column("v").to_pylist(), batch.column("u_text"), batch.column("v_text")):
                if held is None or v != last:
                    last, held = v, shingles(b.as_py())
                keep.append(alike(shingles(a.as_py()), held))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], names=["u", "v"])
        hand_back_memory()

    # a written list of rows is known to be small where it is, so that no other text is shuffled
    needed = written(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "needed")
    own = texts.select("row", "text").join(needed, "row", "left_semi")
    both = (pairs.select("u", "v").join(own.select(F.col("row").alias("u"), F.col("text").alias("u_text")), "u")
            .join(own.select(F.col("row").alias("v"), F.col("text").alias("v_text")), "v"))
    return both.select("u", "v", "u_text", "v_text").mapInArrow(check, "u bigint, v bigint")


def connecting(pairs: DataFrame, texts: DataFrame, shingles: Callable[[str | None], np.ndarray], alike: Callable[[np.ndarray, np.ndarray], bool],
               roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges ``(u, v)`` among ``pairs(u, v, likely)``, distinct and v < u, that connect all that are alike, and the components with them.

    ``likely`` orders a text's partners; ``roots(u, root)`` are components that are known
    already, and no pair may lie within one.
    """
    first = pairs.groupBy("u").agg(F.max_by("v", F.struct("likely", -F.col("v"))).alias("a"), F.min("v").alias("b"))
    first = first.select("u", F.explode(F.array_distinct(F.array("a", "b"))).alias("v"))
    first = written(first, "first")
    found = written(checked(first, texts, shingles, alike), "links")
    if not found.isEmpty() or roots is None:
        roots = extended(roots, found)
    rest = written(across(pairs.select("u", "v").join(first, ["u", "v"], "left_anti"), roots).select("u", "v"), "rest")
    if rest.isEmpty():
        return found, roots
    more = written(checked(rest, texts, shingles, alike), "links")
    if more.isEmpty():
        return found, roots
    return found.unionByName(more), extended(roots, more)
