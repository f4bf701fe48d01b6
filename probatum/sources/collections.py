"""Collections and dated snapshots as Parquet tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.sources.schemas import COLLECTIONS, raw_schema

OPTIONAL = {"pages"}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_raw(spark: SparkSession, root: str, collection: str, json_lines: bool = False) -> DataFrame | None:
    """A raw collection of JSON records; only optional collections may be missing.

    Bad records are kept in ``_corrupt_record`` rather than dropped.  A file that is one
    JSON array is read by one task; large landings are JSON lines.
    """
    path = f"{root}/{collection}.json"
    if not _exists(spark, path):
        if collection in OPTIONAL:
            return None
        raise FileNotFoundError(f"collection {collection} is missing under {root}")
    reader = spark.read.option("multiLine", not json_lines).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    return (reader.schema(raw_schema(collection)) if collection in COLLECTIONS else reader).json(path)


def property_types(frames: dict[str, DataFrame]) -> DataFrame:
    """``(collection, field, type)`` as observed, so that a type change can be found."""
    rows = [(name, field, kind) for name, df in frames.items() for field, kind in df.dtypes]
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(rows, "collection string, field string, type string")


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_collections(frames: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Write all collections or none; returns the row counts, read back from what was written.

    The tables go to a version folder of their own, which gets the file ``complete`` last.
    Until then readers have the whole former version, afterwards the whole new one.  Former
    versions stay.
    """
    spark = next(iter(frames.values())).sparkSession
    version, counts = f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", {}
    for name, df in frames.items():
        df.write.parquet(f"{root}/{version}/{name}")
    for name in frames:
        counts[name] = spark.read.parquet(f"{root}/{version}/{name}").count()
    system, path = _files(spark, root)
    system.create(path(f"{root}/{version}/complete"), False).close()
    return counts


def read_collections(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Collections of the version that was completed last."""
    system, path = _files(spark, root)
    versions = sorted(s.getPath().getParent().getName() for s in system.globStatus(path(f"{root}/version-*/complete")) or [])
    if not versions:
        raise FileNotFoundError(f"no complete collections under {root}")
    return {name: spark.read.parquet(f"{root}/{versions[-1]}/{name}") for name in names}


def write_snapshot(frames: dict[str, DataFrame], root: str, date: str, origin: str = "import") -> None:
    """Add a dated snapshot; a second run on the same date replaces it."""
    for name, df in frames.items():
        (df.withColumn("snapshot_date", F.lit(date)).withColumn("snapshot_origin", F.lit(origin))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("snapshot_date").parquet(f"{root}/{name}"))


def list_snapshots(spark: SparkSession, root: str, table: str = "people") -> DataFrame:
    """``(snapshot_date, age)``, age 1 for the latest."""
    dates = spark.read.parquet(f"{root}/{table}").select(F.col("snapshot_date").cast("string").alias("snapshot_date")).distinct()
    return rank_snapshots(dates)


def rank_snapshots(dates: DataFrame) -> DataFrame:
    # the distinct dates of a partition column: a few rows
    listed = dates.agg(F.sort_array(F.collect_set("snapshot_date"), asc=False).alias("d"))
    return listed.select(F.posexplode("d").alias("age", "snapshot_date")).select("snapshot_date", (F.col("age") + 1).alias("age"))


def load_snapshot(spark: SparkSession, root: str, tables: list[str], date: str | None = None,
                  age: int = 1) -> dict[str, DataFrame]:
    """One snapshot by date, or by age (1 latest, 2 the one before)."""
    if date is None:
        known = {r.age: r.snapshot_date for r in list_snapshots(spark, root, tables[0]).collect()}
        if age not in known:
            raise ValueError(f"need {age} snapshots under {root}, found {len(known)}")
        date = known[age]
    frames = {t: spark.read.parquet(f"{root}/{t}").where(F.col("snapshot_date").cast("string") == date).drop("snapshot_date")
              for t in tables}
    if frames[tables[0]].isEmpty():
        raise ValueError(f"snapshot {date} not found under {root}")
    return frames
