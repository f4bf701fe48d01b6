"""SimHash fingerprints, and all links within a radius by covering locality-sensitive hashing.

Each of the 64 bits gets a vector of ``radius + 1`` bits.  For every such vector v but zero
there is a table whose mask keeps the bits whose vector has an odd product with v.  Any
``radius`` bits span at most ``radius`` dimensions, so some v is orthogonal to all of them:
two fingerprints that differ in these bits alone agree under its mask.  No pair is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from probatum.llm.components import components, least_rows
from probatum.llm.shared import fresh, written

BITS, SHINGLE, SEED, RADIUS = 64, 3, 42, 2
#: buckets of up to so many fingerprints compare them directly, larger ones by their neighbours
DIRECT = 12


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of the text's word shingles, repeats included."""
    words = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space alone
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a:b - 1], SEED) for a, b in zip(starts, ends[size - 1:])], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for part in range(0, len(h), 255):  # the counts of a part fit one byte
        bits = np.unpackbits(h[part:part + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t or "") for t in texts.to_pylist()], dtype=np.uint64).view(np.int64))


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks of the tables; the vectors of the bits run through all but zero in turn."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` between fingerprints (column ``fp``, distinct) that connect all within ``radius`` bits.

    Buckets hold distinct fingerprints.  Small ones compare their members.  In a large one
    a member is written under every value within half the radius of it, in the bits that
    the mask leaves open, and members that meet at a value are within the radius: they are
    linked to the smallest, so no bucket is ever squared.  For radius 2 both ways are exact.
    """
    if radius != 2:
        raise ValueError("links are exact for a radius of 2")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                       for k, m in enumerate(masks)])
    keyed = written(distinct.select("fp", F.inline(tables)), "tables")
    sizes = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(keyed.join(sizes, ["table", "key"]), "buckets")
    small = met.where(F.col("n") <= DIRECT)
    a, b = small.alias("a"), small.alias("b")
    pairs = (a.join(b, ["table", "key"]).where("a.fp < b.fp")
             .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
             .select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v")))
    open_bits = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    near = met.where(F.col("n") > DIRECT).select("fp", F.explode(F.element_at(open_bits, F.col("table") + 1)).alias("flip"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).distinct()
    # at most one member for each bit and the value itself meet at a value
    least = near.groupBy("at").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = near.join(least, "at").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def _classes(marked: DataFrame) -> DataFrame:
    """``fp, component_id`` for the fingerprints of ``marked(doc_id, fp)``, and the component's ``root``."""
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct)).withColumnRenamed("u", "fp")
    rooted = written(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(rooted.join(named, "root").select("fp", "component_id", "root"), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    A-Z count as lower case; null and empty texts have fingerprint 0 and are linked like
    any other.  Equal fingerprints are one node, so copies of any number cost nothing.
    ``component_id`` is the smallest id that is reachable over links of ``RADIUS`` bits or
    fewer (null ids are not counted; a component of null ids alone has null).  Repeated
    rows each give a row, an empty table none; further columns are not read.
    """
    marked = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(_classes(marked), "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def near_rows(rows: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of ``rows(row, text)``, v < u, that connect all rows within ``RADIUS`` bits.

    A row is paired with the smallest row of its fingerprint, and these with one another
    where their fingerprints are linked.
    """
    marked = written(rows.select("row", fingerprints(F.col("text")).alias("fp")), "fingerprints")
    least = written(marked.groupBy("fp").agg(F.min("row").alias("least")), "distinct")
    same = marked.join(least, "fp").where("row > least").select(F.col("row").alias("u"), F.col("least").alias("v"))
    u, v = (least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_row")) for x in "uv")
    met = links(least.select("fp")).join(u, "u").join(v, "v")
    met = met.select(F.greatest("u_row", "v_row").alias("u"), F.least("u_row", "v_row").alias("v"))
    return same.unionByName(met).distinct()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: of the smallest id (null last) and, where rows share it, of the smallest row number."""
    row, = fresh(docs, "row")
    # written once, so that a row's number is the same wherever it is read
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    marked = written(rows.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    stay = least_rows(marked.join(_classes(marked), "fp").select("row", "doc_id", "root"))
    return rows.join(stay.withColumnRenamed("row", row), row, "left_semi").select(*docs.columns)
