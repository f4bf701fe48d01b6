"""All pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

In any order that all texts have in common, the first ``n - ceil(0.8 n) + 1`` elements of the
larger of two such sets and the first ``n - ceil(n / 1.125) + 1`` of the smaller share one
(prefix filter), so no pair is missed.  Shingles that a sample of texts finds common come
last in the order; the sample changes how many pairs are compared, never the result.
Candidates are dropped by size and by parity bits of the sets (both only where the
similarity cannot be reached), and the sets of all others are compared in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.llm.components import across, least_rows
from probatum.llm.confirm import connecting
from probatum.llm.packs import hand_back_memory
from probatum.llm.shared import fresh, release, scope, without, written

#: words of a shingle, and the least similarity of a link as a fraction
SHINGLE, PART, WHOLE = 5, 4, 5
#: the common shingles are told from about so many texts, and so many of them are sent to tasks
SAMPLE_DOCS, COMMON, COMMON_FROM = 4000, 50_000, 3
#: larger buckets compare with a few members first, and in full only what these leave unlinked
DIRECT, PIVOTS, MORE_PIVOTS = 16, 3, 2
PARITY_BITS, LONG_BITS, LONG_FROM = 512, 16_384, 1000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                         0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles: lower case, words between white space; a shorter text is one shingle."""
    words = (text or "").lower().split()
    size = min(size, max(1, len(words)))
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(w) for w in words] or [0], dtype=np.uint64)
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ h[i:len(h) - size + 1 + i]) * _MULTIPLIERS[i % len(_MULTIPLIERS)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes reach the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def prefix(h: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first elements in the shared order, rare before common, of which similar sets have one in common."""
    n = len(h)
    rank = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[at] == h, ranks[at], 0)
    return h[np.lexsort((h, rank))[:n - -(-PART * n // WHOLE) + 1]]


def index_length(n: int) -> int:
    """How many elements of the smaller of two similar sets are enough to meet the prefix of the larger one."""
    return n - -(-2 * PART * n // (WHOLE + PART)) + 1


def parity(h: np.ndarray) -> np.ndarray:
    """Parities of the elements' numbers in ``PARITY_BITS`` classes: sets differ in at least as many elements as in parities.

    The parities of a large set level off; it has those of ``LONG_BITS`` classes besides.
    """
    parts = []
    for bits in (PARITY_BITS, LONG_BITS) if len(h) > LONG_FROM else (PARITY_BITS,):
        odd = np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        parts.append(np.packbits(odd.astype(np.uint8)).view("<i8"))
    return np.concatenate(parts)


def _common(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample in order of hash, and their places in order of number."""
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // SAMPLE_DOCS))) == 0).select("text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, size).view(np.int64))], names=["key"])

    counts = sample.mapInArrow(listed, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_FROM)
    found = counts.orderBy(F.col("n").desc(), "key").limit(COMMON).collect()
    keys = np.array([r.key for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - np.arange(len(keys)))[order]


def _keyed(rows: DataFrame, size: int) -> DataFrame:
    """``row, n, shown, parities, keys`` per text; ``keys`` are the prefix, the first ``shown`` of them that of a smaller set."""
    common, ranks = _common(rows, size)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sets = [shingles(t.as_py(), size) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array([len(h) for h in sets], pa.int32()), pa.array([index_length(len(h)) for h in sets], pa.int32()),
                     pa.array([parity(h) for h in sets], pa.list_(pa.int64())),
                     pa.array([prefix(h, common, ranks).view(np.int64) for h in sets], pa.list_(pa.int64()))],
                    names=["row", "n", "shown", "parities", "keys"])
        hand_back_memory()
    return rows.select("row", "text").mapInArrow(mark, "row bigint, n int, shown int, parities array<bigint>, keys array<bigint>")


def _apart(a: Column, b: Column, long: bool) -> Column:
    """In how many classes two sets have different parities."""
    if not long:
        return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    tail = lambda x: F.slice(x, PARITY_BITS // 64 + 1, LONG_BITS // 64)
    return F.aggregate(F.zip_with(tail(a), tail(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def _possible(a: str, b: str, long: bool = True) -> Column:
    """Whether sizes and parities leave the similarity within reach; without ``long`` only the first parities are looked at."""
    n, m, p, q = (F.col(f"{x}.{c}") for c in ("n", "parities") for x in (a, b))
    reach = (WHOLE - PART) * (n + m)
    possible = (WHOLE * F.least(n, m) >= PART * F.greatest(n, m)) & ((WHOLE + PART) * _apart(p, q, False) <= reach)
    if not long:
        return possible
    both_long = (n > LONG_FROM) & (m > LONG_FROM)
    return possible & F.when(both_long, (WHOLE + PART) * _apart(p, q, True) <= reach).otherwise(F.lit(True))


def links(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Edges ``(u, v)`` between ``rows(row, text)``, row numbers distinct, that connect all pairs of similar texts."""
    return linked(rows, size)[0]


def linked(rows: DataFrame, size: int = SHINGLE, near: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``links``, and the components ``(u, root)`` that they make.

    Pairs ``(u, v)``, v < u, that ``near`` finds among the rows are compared first, and what
    links connect by then is not compared again.

    A bucket is a shingle: sets that show it as the smaller of a pair meet those that have
    it in their longer prefix.  Small buckets compare all of these.  The members of a large
    one are compared with a few of them; only pairs that no links connect by then, and that
    sizes and parities leave possible, are compared after that.  A long text is a member of
    very many buckets: parities are met by pairs, once each, and never written with members.
    """
    of = partial(shingles, size=size)
    marked = written(_keyed(rows, size), "prefixes")
    by_key = marked.select("row", "n", F.posexplode("keys").alias("at", "key"), "shown").select("key", "row", "n", (F.col("at") < F.col("shown")).alias("shows"))
    sizes = by_key.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bool_or("shows").alias("any")).where("size > 1 AND any").select("key", "size")
    met = written(by_key.join(written(sizes, "sizes"), "key"), "buckets")
    about = marked.select("row", "n", "parities")

    def meeting() -> Column:
        """A set that shows the key beside a larger one (of equal sizes, either)."""
        return F.expr("a.row <> b.row AND b.shows AND (a.n > b.n OR a.n = b.n AND (a.row > b.row OR NOT a.shows))")

    def worth(pairs: DataFrame, about: DataFrame) -> DataFrame:
        """``u, v, likely``: pairs that are not told apart by size and parities."""
        a, b = about.alias("a"), about.alias("b")
        pairs = pairs.distinct().alias("p")
        return (pairs.join(a, F.col("p.u") == F.col("a.row")).join(b, F.col("p.v") == F.col("b.row"))
                .where(_possible("a", "b")).select("p.u", "p.v", (-_apart(F.col("a.parities"), F.col("b.parities"), False)).alias("likely")))

    named = F.greatest("a.row", "b.row").alias("u"), F.least("a.row", "b.row").alias("v")
    close = F.expr(f"{WHOLE} * least(a.n, b.n) >= {PART} * greatest(a.n, b.n)")
    small = met.where(F.col("size") <= DIRECT)
    pairs = small.alias("a").join(small.alias("b"), "key").where(meeting() & close).select(*named)
    found, roots = None, None
    if near is not None:
        found, roots = connecting(written(near(rows).withColumn("likely", F.lit(0)), "near"), rows, of, alike)
    large = met.where(F.col("size") > DIRECT)
    for nth in range(PIVOTS):
        chosen = large.groupBy("key").agg(F.min_by(F.struct("row", "n"), F.xxhash64("row", F.lit(nth))).alias("b"))
        pairs = pairs.unionByName(large.alias("a").join(chosen, "key").where("a.row <> b.row").where(close).select(*named))
    pairs = pairs if roots is None else across(pairs.distinct(), roots).select("u", "v")
    new, roots = connecting(written(worth(pairs, about), "candidates"), rows, of, alike, roots)
    found = new if found is None else found.unionByName(new)
    if large.isEmpty():
        return found, roots

    def still_open(members: DataFrame) -> DataFrame:
        """Members of large buckets that links don't connect to one another; a bucket that is connected stays so."""
        rooted = members.join(roots.withColumnRenamed("u", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        rooted = written(rooted, "rooted")
        open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        left = written(rooted.join(open_keys, "key"), "open")
        release(rooted)
        return left

    left = still_open(large)
    # what is open later is part of it
    about = written(about.join(left.select("row").distinct(), "row", "left_semi"), "about")
    for nth in range(MORE_PIVOTS):
        if left.isEmpty():
            return found, roots
        # another member, by turns of any component and of those that hold few
        first = F.xxhash64("root" if nth % 2 else "row", F.lit(PIVOTS + nth))
        chosen = left.groupBy("key").agg(F.min_by(F.struct("row", "n", "root"), first).alias("b"))
        more = left.alias("a").join(chosen, "key").where("a.root <> b.root").where(close).select(*named)
        new, roots = connecting(written(worth(more, about), "candidates"), rows, of, alike, roots)
        if new.isEmpty():
            break
        found = found.unionByName(new)
        last, left = left, still_open(left.drop("root"))
        release(last)
    left = left.join(about.select("row", F.slice("parities", 1, PARITY_BITS // 64).alias("parities")), "row")
    more = left.alias("a").join(left.alias("b"), "key").where(meeting() & F.expr("a.root <> b.root")).where(_possible("a", "b", long=False)).select(*named)
    new, roots = connecting(written(worth(more, about), "candidates"), rows, of, alike, roots)
    return found.unionByName(new), roots


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Of the rows that links of similar texts connect, the one with the smallest id (null last), and of equal ids one row.

    Pairs that ``near`` finds are compared first (see ``linked``); they need not be all.  Texts without words are all alike; an empty table gives no rows.
    """
    row, = fresh(docs, "row")
    with scope(docs.sparkSession) as tables:
        # written once, so that a row's number is the same wherever it is read
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        texts = rows.select(F.col(row).alias("row"), F.col(text).alias("text"))
        roots = linked(texts, size, near)[1].withColumnRenamed("u", "row")
        members = roots.unionByName(roots.select(F.col("root").alias("row"), "root").distinct())
        ids = written(members.join(rows.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id")), "row"), "linked")
        gone = written(ids.select("row").join(least_rows(ids), "row", "left_anti").select(F.col("row").alias(row)), "gone")
        kept = without(rows, gone, [row]).select(*docs.columns)
        tables.keep(kept)
    return kept
