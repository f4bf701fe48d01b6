"""Exact duplicates through a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest.  New rows are reduced to one row per
digest, met with the index by a sort-merge anti-join that leaves the index unshuffled, and
what is new is appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm.shared import catalog_table, fresh, scope, without, written

#: columns of the index table
INDEX = "digest string, keep_id bigint, first_size bigint"
#: rows of one digest are spread over so many partitions where they meet the index
SALTS, HOT_ROWS = 64, 1000


class DigestIndex:
    """A bucketed table of the digests seen so far.

    ``name`` is the table's name in the warehouse, ``buckets`` its number of buckets
    (default: the session's shuffle partitions), which stays as it was at creation.
    ``lasting`` indexes stay until they are dropped; the others go with the job around them.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, lasting: bool = True):
        self.spark, self.name = spark, name if lasting else catalog_table(spark, name)
        if spark.catalog.tableExists(name):
            told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
            self.buckets = int(told["Num Buckets"])
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._write(spark.createDataFrame([], INDEX), "errorifexists")

    def _write(self, df: DataFrame, mode: str) -> None:
        (df.write.format("parquet").mode(mode).bucketBy(self.buckets, "digest").sortBy("digest")
         .saveAsTable(self.name))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """Deduplicate ``docs`` against the index and itself, and append what is new.

        Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``
        and the columns in ``carry``.  Texts are equal when identical; null counts as the
        empty text.  Of equal texts the row with the largest id stays (null ids are smaller
        than all others; of repeated rows with that id exactly one stays, which is decided
        by ``carry`` where rows differ in it), unless the index knew the text before: then
        ``keep_id`` is the id it knew.  ``group_size`` counts the rows of this batch.  A
        batch that is added again, after a crash for instance, gets the same decisions.
        An empty table gives no rows; further columns are not read.  Ids are whole numbers.
        """
        body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
        more = [f"carried{i}" for i in range(len(carry))]
        with scope(self.spark) as tables:
            keyed = written(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.sha2(body, 256).alias("digest"),
                                        *[F.col(c).alias(m) for c, m in zip(carry, more)], F.monotonically_increasing_id().alias("row")), "digests")
            place = F.struct("doc_id", *more, "row")
            groups = written(keyed.groupBy("digest").agg(F.max(place).alias("last"), F.count(F.lit(1)).alias("n")), "groups")
            seen = self.table().select("digest").hint("merge")
            new = (groups.join(seen, "digest", "left_anti")
                   .select("digest", F.col("last.doc_id").alias("keep_id"), F.col("n").alias("first_size")))
            # one file per bucket and batch
            self._write(new.repartition(self.buckets, "digest"), "append")
            known = self.table().select("digest", "keep_id").hint("merge")
            decided = groups.join(known, "digest").select("digest", "keep_id", "last", "n")
            # texts with many copies are few: their rows and the row they meet are spread
            salts = F.when(F.col("n") > HOT_ROWS, F.lit(SALTS)).otherwise(F.lit(1))
            spread = decided.select("*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
            hot = written(groups.where(F.col("n") > HOT_ROWS).select("digest", F.lit(True).alias("hot")), "hot")
            decided = written(spread, "decided")
            salted = keyed.join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
            out = salted.join(decided, ["digest", "salt"])
            is_last = place.eqNullSafe(F.col("last"))
            out = out.select("doc_id", "keep_id", F.col("n").alias("group_size"),
                             (is_last & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                             F.col("digest").alias("text_sha256"), *[F.col(m).alias(c) for c, m in zip(carry, more)])
            tables.keep(keyed, hot, decided)
        return out


def keep_first_copies(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see ``DigestIndex.add``).

    Rows are decided on by id, digest and two hashes of all their columns, without their
    texts; those that go are dropped by these hashes.  Of rows with equal id and text the
    one with the largest hashes stays, one of rows that are equal in all columns.
    """
    one, other = fresh(docs, "row_hash", "row_hash2")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumns({one: F.xxhash64(*columns), other: F.xxhash64(F.lit(1), *columns)})
    with scope(docs.sparkSession) as tables:
        told = index.add(hashed, doc_id, text, (one, other))
        rows = told.groupBy(one, other).agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
        # those that go, and those of which there are copies
        odd = written(rows.where("NOT stays OR n > 1"), "odd")
        kept = without(hashed, odd, [one, other])
        again = written(odd.where("stays").select(one, other), "again")
        if not again.isEmpty():
            kept = kept.unionByName(hashed.join(again, [one, other], "left_semi").dropDuplicates([one, other]))
        tables.keep(odd, again)
    return kept.select(*docs.columns)
