"""Mix sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, its source's target over its
source's size.  The expected copies are summed along the source's documents, one offset
(the constant 0.5 unless another is given) is added, and a document is taken once per integer boundary that its part of the sum
crosses.  Documents run in order of size, so that each stretch of the sum holds like sizes
and the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum.llm.shared import WORD, fresh, scope, written
from probatum.operators.scale import fits_broadcast

#: weights of the sources in code point order, repeating
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = 10
#: the list of rows that the mix takes is sent to all tasks up to so many bytes, and shuffled beyond
SENT_BYTES = 16 << 20


def _numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``row_number`` (from 1) per key over ranges, so that a key of any size is numbered in many tasks."""
    ranged = df.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys], *order)
    ranged = written(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("__part", *keys).orderBy(*order)
    sizes = ranged.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rows = ranged.withColumn("__local", F.row_number().over(local)).alias("r")
    on = F.col("r.__part") == F.col("s.__part")
    for k in keys:
        on &= F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    return rows.join(starts.alias("s"), on).select(
        *[F.col(f"r.{c}") for c in df.columns], (F.col("s.__start") + F.col("r.__local")).alias(name))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets per source from ``(source, source_size, n_docs)``: adds ``weight, target``.

    All targets together are ``share`` of all sizes, split by weight; none is above
    ``most`` times its source's size, what is above goes to the others by weight, again
    and again until none is.  Sources of size 0 get 0.  The table has a row per source and
    is never collected; a round is one aggregate.
    """
    listed = _numbered(sizes, [], [F.col("source").asc_nulls_last()], "place")
    by_place = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    listed = written(listed.withColumn("weight", by_place).drop("place"), "sources")
    capacity = F.col("source_size") * F.lit(float(most))
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    budget = min(share, most) * total
    per_weight, full = 0.0, -1
    while True:
        is_full = F.col("weight") * F.lit(per_weight) >= capacity
        n, held, rest = listed.agg(F.count_if(is_full), F.sum(F.when(is_full, capacity).otherwise(0.0)),
                                   F.sum(F.when(is_full, 0.0).otherwise(F.col("weight")))).first()
        if n == full or not rest:
            break
        full, per_weight = n, (budget - held) / rest
    return listed.withColumn("target", F.least(capacity, F.col("weight") * F.lit(per_weight)))


def source_offset(source: Column, seed: int = SEED) -> Column:
    """The first 32 bits of the md5 of ``seed:source`` (null: empty) as a fraction of 2^32."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies, taken``, and the columns in ``carry``, for every row.

    ``size`` counts words between ASCII white space (null text: 0); ``copies`` is 0 to
    ``most``; ``taken`` = copies times size.  ``seed`` draws an offset in [0, 1) for
    each source (see ``source_offset``); the same seed gives the same mix.  Rows of equal size run by id, equal ids together
    (repeated rows may change places among themselves, which changes nothing).  A null
    source is a source of its own, last in order; null ids come last.  An empty table
    gives no rows; further columns are not read.
    """
    with scope(docs.sparkSession) as tables:
        rows = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                   F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), *carry), "sizes")
        totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        targets = source_targets(totals, weights, share, most)
        placed = _numbered(rows, ["source"], [F.col("size").asc(), F.col("doc_id").asc_nulls_last()], "place").alias("p")
        # a row per source: far fewer than documents, but of no proven bound, so the plan chooses the join
        joined = placed.join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        tables.keep(joined)
    expected = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(F.lit(0.0))
    upto = lambda place: F.floor(place * expected + source_offset(F.col("t.source"), seed))
    copies = (upto(F.col("p.place")) - upto(F.col("p.place") - 1)).cast("bigint")
    return joined.select("p.doc_id", "p.size", "p.source", "t.source_size", "t.target", copies.alias("copies"),
                         (copies * F.col("p.size")).alias("taken"), *[F.col(f"p.{c}") for c in carry])


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as ``mix`` takes it."""
    row, copies, nth = fresh(docs, "row", "copies", "nth")
    with scope(docs.sparkSession) as tables:
        # written once, so that a row's number is the same for its size and for its text
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        wanted = mix(rows, doc_id, text, source, carry=(row,), **how).where("copies > 0").select(row, F.col("copies").alias(copies))
        wanted = written(wanted, "wanted")
        joined = rows.join(F.broadcast(wanted) if fits_broadcast(wanted, SENT_BYTES) else wanted, row)
        tables.keep(joined)
    each = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(nth)
    return joined.select(*docs.columns, each).drop(nth)
