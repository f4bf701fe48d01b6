"""Similarity join of texts' shingle sets along chosen paths.

A tree deals out the sets level by level: each node chooses ``BRANCHES`` minwise hash
functions, and a set goes to the child named by its least token under each of them.  Two
sets of similarity j go the same way at a branch with probability j, so at j = 0.8 and two
branches a pair dies out in a tree with probability q = (0.2 + 0.8 q)^2 = 0.0625 at most,
however deep it is.  ``TREES`` independent trees lose it with q^TREES, 1.5e-5 for four.
Small nodes compare their members exhaustively by sketches, minwise tokens and parities;
what these leave is checked on the full sets.  Parities lose nothing: sets differ in at least
as many tokens as in parities.

First the members of a node are compared with one of them, in a larger node with a few, and
nodes whose members are all connected by then are closed.  A node is small if few of its members lie outside its largest
component: only sets of different components need comparing.  Nodes that are still not
small at the last level are compared exhaustively, all in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.llm.components import across, extended
from probatum.llm.confirm import checked, connecting
from probatum.llm.shared import only, release, scope, sized_in_memory, without, written

#: words of a shingle, and the least similarity of a link as a fraction
SHINGLE, PART, WHOLE = 2, 80, 100
TREES, BRANCHES, DEPTH = 4, 2, 5
#: members outside the largest component of a node that is compared exhaustively; members of a block of a larger node
SMALL, BLOCK = 64, 256
#: members of a node beyond ``SMALL`` that all others are compared with first
PIVOTS = 4
#: minwise tokens of a set; the first are the ways out of the roots
POSITIONS = 96
#: tokens that a pair must share of them: at similarity 0.8 they are 76.8 on average, 58 or fewer in 3 of a million cases
AGREE = 59
#: classes of which a sketch holds the parities of a set's tokens
CLASSES = 1024

_MIX = np.random.default_rng(12).integers(1 << 32, size=(2, POSITIONS), dtype=np.uint64).astype(np.uint32) | np.array([[0], [1]], dtype=np.uint32)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, in order; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(size, len(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ h[i:len(h) - size + 1 + i]) * _STEPS[i % len(_STEPS)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def minwise(h: np.ndarray) -> np.ndarray:
    """The least token of a set under each of ``POSITIONS`` hash functions."""
    folded = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    best = np.full(POSITIONS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(h), 4096):
        mixed = (folded[at:at + 4096, None] ^ _MIX[0]) * _MIX[1]
        mixed ^= mixed >> np.uint32(15)
        best = np.minimum(best, (mixed * np.uint32(0x2C1B3C6D)).min(axis=0))
    return best


def parity(h: np.ndarray) -> bytes:
    """Whether a set has an odd number of tokens in each of ``CLASSES`` classes, as bits."""
    odd = np.bincount((h % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _marked(texts: DataFrame) -> DataFrame:
    """``row, n, digest, tokens, sketch`` of every text: ``tokens`` lead through the trees, a byte of each and the parities are the sketch."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sizes, digests, tokens, parities = [], [], [], []
                for t in part.column("text"):
                    h = shingles(t.as_py())
                    sizes.append(len(h))
                    digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                    tokens.append(minwise(h))
                    parities.append(parity(h))
                every = np.array(tokens, dtype=np.uint32)
                sketches = [row.tobytes() + odd for row, odd in zip(every.astype(np.uint8), parities)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * POSITIONS), pa.array(every.reshape(-1).view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), lists, pa.array(sketches, pa.binary())],
                                                 names=["row", "n", "digest", "tokens", "sketch"])
    return texts.select("row", "text").mapInArrow(mark, "row bigint, n int, digest binary, tokens array<int>, sketch binary")


# ------------------------------------------------------------------ nodes
def _children(node: Column, tokens: Column, first: bool) -> Column:
    """The children of a node that a set goes to: one for each of two different positions, which the node chooses.

    The ways out of the roots have positions of their own, so that trees don't share them.
    """
    if first:
        at = [(t * BRANCHES + b, F.lit(t)) for t in range(TREES) for b in range(BRANCHES)]
        return F.array(*[F.xxhash64(F.lit(p), tokens[p]) for p, _ in at])
    free = POSITIONS - TREES * BRANCHES
    one = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(free)).cast("int")
    other = F.pmod(one + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(free - 1)).cast("int"), F.lit(free)).cast("int")
    return F.array(*[F.xxhash64(node, F.lit(b), tokens[p + TREES * BRANCHES]) for b, p in enumerate((one, other))])


def _near(n: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs may be alike by size and sketch, and how many tokens they share."""
    tokens, odd = sketch[:, :POSITIONS], sketch[:, POSITIONS:].view(np.uint64)
    fits = WHOLE * np.minimum(n[i], n[j]) >= PART * np.maximum(n[i], n[j])
    same = np.zeros(len(i), dtype=np.int32)
    at = np.flatnonzero(fits)
    for start in range(0, len(at), 100_000):
        part = at[start:start + 100_000]
        apart = np.bitwise_count(odd[i[part]] ^ odd[j[part]]).sum(axis=1, dtype=np.int64)
        part = part[(WHOLE + PART) * apart <= (WHOLE - PART) * (n[i[part]].astype(np.int64) + n[j[part]])]
        same[part] = (tokens[i[part]] == tokens[j[part]]).sum(axis=1)
    return same >= AGREE, same


def _sketches(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, POSITIONS + CLASSES // 8)


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    sketch = _sketches(table["sketch"].to_pylist())
    return table["node"].to_numpy(), table["row"].to_numpy(), table["n"].to_numpy(), table["root"].to_numpy(), sketch


def compared(members: DataFrame) -> DataFrame:
    """``u, v, likely``: pairs of members ``(node, row, n, root, sketch)`` of one node, of different roots, that may be alike.

    Nodes are bounded; a task reads them one after the other and holds the last one over.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            node, row, n, root, sketch = _columns(table)
            for apart in range(1, len(node)):
                i = np.flatnonzero(node[:-apart] == node[apart:])
                if not len(i):
                    break
                i = i[root[i] != root[i + apart]]
                good, same = _near(n, sketch, i, i + apart)
                i, same = i[good], same[good]
                if len(i):
                    a, b = row[i], row[i + apart]
                    yield pa.RecordBatch.from_pydict({"u": np.maximum(a, b), "v": np.minimum(a, b), "likely": same})

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            node = held["node"].to_numpy()
            cut = int(np.searchsorted(node, node[-1])) if len(node) else 0
            if cut:
                yield from pairs(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from pairs(held)

    dealt = members.select("node", "row", "n", "root", "sketch").repartition("node").sortWithinPartitions("node", "row")
    return dealt.mapInArrow(run, "u bigint, v bigint, likely int").where("u <> v")


def _stars(nodes: DataFrame, about: DataFrame) -> DataFrame:
    """``u, v``: members of ``nodes(node, row, n, root, size)`` beside one member of each, in larger nodes beside a few, where they may be alike.

    Members of one component need no comparing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            both = _sketches(batch.column("sketch").to_pylist() + batch.column("other").to_pylist())
            k = batch.num_rows
            good, _ = _near(np.concatenate([n, m]), both, np.arange(k), np.arange(k, 2 * k))
            good = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(good), batch.column("v").filter(good)], names=["u", "v"])

    # by the row alone: nodes of one group of similar sets mostly choose the same members
    first = [F.min_by(F.struct(F.col("row").alias("pivot"), F.col("n").alias("m"), F.col("root").alias("to")), F.xxhash64("row", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)]
    chosen = nodes.groupBy("node").agg(F.max("size").alias("most"), *first)
    several = F.when(F.col("most") > SMALL, F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).otherwise(F.array("p0"))
    met = nodes.join(chosen.select("node", F.inline(several)), "node").where("root <> to")
    # a pair meets in many nodes: sketches join the distinct pairs whose sizes fit
    met = met.where(f"{WHOLE} * least(n, m) >= {PART} * greatest(n, m)").select(F.greatest("row", "pivot").alias("u"), F.least("row", "pivot").alias("v")).distinct()
    u, v = about.select(F.col("row").alias("u"), "n", "sketch"), about.select(F.col("row").alias("v"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    return met.join(u, "u").join(v, "v").select("u", "v", "n", "m", "sketch", "other").mapInArrow(run, "u bigint, v bigint")


def _main_blocks(small: DataFrame) -> DataFrame:
    """Members of small nodes in blocks: those outside the largest component are in every block of their node."""
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.array(F.pmod(F.xxhash64("row"), count).cast("int"))
    blocks = F.when(F.col("root") == F.col("main"), own).otherwise(F.sequence(F.lit(0), count - 1))
    return small.select(F.explode(blocks).alias("block"), "*").select(F.xxhash64("node", "block").alias("node"), "row", "root")


def _pair_blocks(large: DataFrame) -> DataFrame:
    """Members of large nodes under every pair of blocks that theirs is part of: any two of a node meet, and no group is large."""
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("row"), count).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda b: F.xxhash64("node", F.least(b, F.col("own")), F.greatest(b, F.col("own"))))
    return (large.withColumn("count", count).withColumn("own", own).withColumn("pair", F.explode(pairs))
            .select(F.col("pair").alias("node"), "row", "root"))


def linked(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Components ``(u, root)`` by all pairs of similar ``sets(row, n, tokens, sketch)``, distinct and none empty."""
    about = sets.select("row", "n", "sketch")
    level = sets.select("row", "n", F.col("row").alias("root"), F.explode(_children(F.lit(0), F.col("tokens"), True)).alias("node"))
    pairs, roots = [], None
    for depth in range(1, DEPTH + 1):
        level = written(level, "level", readers=1)
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = written(level.join(sizes, "node"), "nodes")
        new = written(checked(written(_stars(sized, about), "stars"), texts, shingles, alike), "links")
        roots = extended(roots, new)
        rooted = written(sized.drop("root").join(roots.withColumnRenamed("u", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")), "rooted")
        release(sized)
        # by node and component, then the largest of a node: no node is gathered
        parts = rooted.groupBy("node", "root").agg(F.count(F.lit(1)).alias("k"))
        still = parts.groupBy("node").agg(F.max_by("root", "k").alias("main"), F.max("k").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
        still = written(rooted.join(still, "node"), "open")
        release(rooted)
        is_small = F.col("size") - F.col("most") <= SMALL
        pairs.append(written(compared(_main_blocks(still.where(is_small)).join(about, "row")), "pairs"))
        large = still.where(~is_small)
        if depth == DEPTH:
            pairs.append(written(compared(_pair_blocks(large).join(about, "row")), "pairs"))
        elif large.isEmpty():
            break
        else:
            # the sets that go on: later levels hold no others
            sets = written(only(sets, written(large.select("row").distinct(), "rows-on"), ["row"]), "going-on")
            about = sets.select("row", "n", "sketch")
            level = (large.select("node", "row", "root").join(sets.select("row", "n", "tokens"), "row")
                     .select("row", "n", "root", F.explode(_children(F.col("node"), F.col("tokens"), False)).alias("node")))
    found = reduce(DataFrame.unionByName, pairs).groupBy("u", "v").agg(F.max("likely").alias("likely"))
    found = across(found, roots).select("u", "v", "likely")
    return connecting(written(found, "candidates"), texts, shingles, alike, roots)[1]


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    A set holds the distinct two-word shingles of the whole text, A-Z in lower case, words
    between ASCII white space; a text of one word is one shingle.  Texts without words,
    null too, have empty sets and are linked with nothing: ``component_id`` is their own
    id.  Equal sets are one node, so copies of any number cost nothing.  Null ids are not
    counted for ``component_id`` (a component of null ids alone has null) and are never
    kept.  Repeated rows each give a row, an empty table none; further columns are not read.
    """
    with sized_in_memory(docs.sparkSession), scope(docs.sparkSession) as tables:
        rows = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")), "rows")
        marked = written(_marked(rows), "marked")
        groups = written(marked.where("n > 0").groupBy("digest", "n").agg(F.min("row").alias("rep")), "groups")
        copies = written(marked.where("n > 0").select("row").join(groups.select(F.col("rep").alias("row")), "row", "left_anti"), "copies")
        sets = written(without(marked.where("n > 0"), copies, ["row"]).select("row", "n", "tokens", "sketch"), "sets")
        roots = linked(sets, rows)
        classed = groups.join(roots.withColumnRenamed("u", "rep"), "rep", "left").select("digest", "n", F.coalesce("root", "rep").alias("root"))
        member = marked.select("row", "n", "digest").join(rows.select("row", "doc_id"), "row").join(classed, ["digest", "n"], "left")
        member = written(member.select("row", "doc_id", "n", "root"), "members")
        least = member.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
        named = written(member.join(least, "root", "left").select(
            "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")), "classes")
        tables.keep(named)
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
