"""Ranked lexical search as blocked matrix products.

Items come in blocks, and a block's items in tiles, each with a compact vocabulary: the
terms of its own items.  Documents meet a tile as a dense matrix of term impacts, which is
multiplied by the tile's matrix of term weights.  All entries are integers held in float64;
a tile has so few columns that no sum reaches 2^53, so the products are exact.  Each task
keeps the best documents of each item, ties cut by document id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probatum.llm.shared import scope, written

TOP = 50
#: bytes of item texts that one pass over the documents serves
BLOCK_BYTES = 4 << 20
#: items of a tile, its columns at most, and documents multiplied at once
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 128, 4096, 512
#: no impact is larger
MOST_IMPACT = 1_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all that is not ASCII, A-Z in lower case."""
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Tile:
    """Items of a block with their weights per column; ``column`` leads from the block's terms to the tile's, or to -1."""
    items: np.ndarray
    column: np.ndarray
    weights: np.ndarray


def tiles(listed: list[np.ndarray], weight: np.ndarray) -> list[list[Tile]]:
    """Items in tiles; the inner lists split a tile's columns, and their products add up."""
    width = max(1, min(TILE_TERMS, (2 ** 53 - 1) // (MOST_IMPACT * max(1, int(weight.max(initial=1))))))
    out = []
    for start in range(0, len(listed), TILE_ITEMS):
        part = listed[start:start + TILE_ITEMS]
        own = np.unique(np.concatenate(part))
        out.append([])
        for at in range(0, len(own), width):
            chosen = own[at:at + width]
            column = np.full(len(weight), -1, dtype=np.int32)
            column[chosen] = np.arange(len(chosen))
            weights = np.zeros((len(chosen), len(part)))
            for i, item in enumerate(part):
                held = column[item]
                weights[held[held >= 0], i] = weight[item[held >= 0]]
            out[-1].append(Tile(np.arange(start, start + len(part)), column, weights))
    return out


def _counted(numbers: dict[bytes, int]):
    """``doc_id, n, terms, counts``: all terms of a document, and those of the block with their occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, found, counts = [], [0], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                listed = terms(text.as_py())
                held = Counter(map(numbers.get, listed))
                held.pop(None, None)
                sizes.append(len(listed))
                found.extend(held.keys())
                counts.extend(held.values())
                ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))], names=["doc_id", "n", "terms", "counts"])
    return run


class Best:
    """The ``top`` best documents of each item so far: score downwards, equal scores by id, null ids last."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, dtype=np.int64)
        self.held = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # item, score, whether the id is null, id

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """``scores`` has a row per document and a column per item."""
        least = self.least[items]
        if len(scores) > self.top:  # whatever is under this tile's own top is out, ties stay
            least = np.maximum(least, np.partition(scores, -self.top, axis=0)[-self.top])
        doc, col = np.nonzero(scores >= least)
        if not len(doc):
            return
        new = [items[col], scores[doc, col], no_id[doc], ids[doc]]
        held = [np.concatenate(x) for x in zip(self.held, new)]
        order = np.lexsort((held[3], held[2], -held[1], held[0]))
        held = [x[order] for x in held]
        starts = np.concatenate(([True], held[0][1:] != held[0][:-1])) if len(order) else np.zeros(0, dtype=bool)
        first = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
        place = np.arange(len(order)) - first
        self.held = [x[place < self.top] for x in held]
        full = place == self.top - 1
        self.least[held[0][full]] = held[1][full]


def _scored(parts: list[list[Tile]], n_items: int, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_items, top)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(start, TILE_DOCS)
                length = np.array([50 + 50 * n * n_docs // n_terms for n in part.column("n").to_pylist()], dtype=np.int64)
                lists = part.column("terms")
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                term = lists.flatten().to_numpy()
                tf = part.column("counts").flatten().to_numpy().astype(np.int64)
                impact = (1_000_000_000 * tf // (1000 * tf + 20 * length[row])).astype(np.float64)
                no_id = part.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = part.column("doc_id").fill_null(0).to_numpy()
                for tile in parts:
                    scores = np.zeros((part.num_rows, len(tile[0].items) if tile else 0), dtype=np.int64)
                    for piece in tile:
                        column = piece.column[term]
                        met = column >= 0
                        dense = np.zeros((part.num_rows, len(piece.weights)))
                        dense[row[met], column[met]] = impact[met]
                        scores += (dense @ piece.weights).astype(np.int64)
                    if tile:
                        best.add(tile[0].items, scores, ids, no_id)
        item, score, no_id, ids = best.held
        yield pa.RecordBatch.from_pydict({"item": item, "doc_id": pa.array(ids, pa.int64(), mask=no_id.astype(bool)), "score": score})
    return run


def _block(docs: DataFrame, listed: list[tuple[int, bytes]], top: int) -> DataFrame:
    """``row, doc_id, score``: the best documents of each task for the items ``(row, text)``."""
    numbers: dict[bytes, int] = {}
    rows = np.array([row for row, _ in listed])
    own = [np.array(sorted({numbers.setdefault(t, len(numbers)) for t in terms(text)}), dtype=np.int64) for _, text in listed]
    counted = written(docs.mapInArrow(_counted(numbers), "doc_id bigint, n bigint, terms array<int>, counts array<int>"), "postings", readers=1)
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # a row per term of the block
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    df = np.zeros(len(numbers), dtype=np.int64)
    df[[r.term for r in held]] = [r.df for r in held]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    scored = counted.where("n > 0").mapInArrow(_scored(tiles(own, weight), len(rows), n_docs, n_terms, top), "item bigint, doc_id bigint, score bigint")
    # a row per item of the block
    lookup = docs.sparkSession.createDataFrame([(i, int(r)) for i, r in enumerate(rows)], "item bigint, row bigint")
    scored = scored.join(F.broadcast(lookup), "item")
    return written(scored.select("row", "doc_id", "score"), "best")


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item, all whose score is above 0 if fewer.

    Ids of documents are whole numbers.  Null and empty texts have no terms: such documents
    count for nothing, such items have no rows.  Every row of ``items`` is ranked by
    itself, repeated rows and null ids too; repeated documents are ranked one by one.
    Equal scores run by ascending id, null ids last.  Empty tables give no rows; further
    columns are not read.  Items beyond ``BLOCK_BYTES`` take a further pass over the
    documents for each such block.
    """
    spark, kind = docs.sparkSession, items.schema[item_id].dataType.simpleString()
    bodies = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    with scope(spark) as tables:
        listed = written(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("item_id"), F.encode(item_text, "utf-8").alias("text")), "items")
        size = listed.agg(F.sum(F.octet_length("text"))).first()[0]
        found = None
        blocks = -(-(size or 0) // BLOCK_BYTES)
        for block in range(blocks):
            # dealt by hash: about BLOCK_BYTES of texts each
            own = listed.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "text").collect()
            best = _block(bodies, [(r.row, bytes(r.text or b"")) for r in own], top)
            found = best if found is None else found.unionByName(best)
        if found is None:
            return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
        order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out = ranked.join(listed.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
        tables.keep(out)
        return out
