"""Helpers that several operators share: tables in the shared folder, plain words."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.lifetimes import catalog_table, release, scope, shared_folder, sweep, written
from probatum.operators.scale import fits_broadcast

__all__ = ["WORD", "ascii_lower", "catalog_table", "fresh", "id_remainder", "only", "release", "scope", "shared_folder", "sized_in_memory", "sweep", "without", "written"]

#: a word of the plain tokenisation: everything between ASCII white space
WORD = r"[^\x20\x09-\x0D]+"

#: bytes of a hash table in memory for each byte of a Parquet table of row numbers, about
IN_MEMORY = 8


@contextmanager
def sized_in_memory(spark: SparkSession, factor: int = IN_MEMORY) -> Iterator[None]:
    """Joins planned inside broadcast tables by what they take in memory, not by their compressed files.

    A broadcast is put together in the driver.  By its files a table of row numbers seems small
    enough for one while it takes eight times as much there; several are held at once.
    """
    files, adaptive = "spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    known = spark._jsparkSession.sessionState().conf()
    before = {key: spark.conf.get(key) if known.contains(key) else None for key in (files, adaptive)}
    spark.conf.set(files, str(float(spark.conf.get(files)) * factor))
    if (limit := int(known.autoBroadcastJoinThreshold())) > 0 and before[adaptive] is None:
        spark.conf.set(adaptive, str(limit // factor))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame doesn't have: the given ones with underscores before them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(rows: DataFrame, gone: DataFrame, on: list[str], limit: int = 16 << 20) -> DataFrame:
    """``rows`` but those in the written table ``gone``: broadcast up to ``limit`` bytes of it, joined by shuffle beyond."""
    return rows.join(F.broadcast(gone) if fits_broadcast(gone, limit) else gone, on, "left_anti")


def only(rows: DataFrame, stay: DataFrame, on: list[str], limit: int = 16 << 20) -> DataFrame:
    """``rows`` that are in the written table ``stay``: broadcast up to ``limit`` bytes of it, joined by shuffle beyond."""
    return rows.join(F.broadcast(stay) if fits_broadcast(stay, limit) else stay, on, "left_semi")
