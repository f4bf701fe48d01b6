"""Compare two snapshots: changes, what looks wrong about them, and the diff rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum import fixed
from probatum.operators import snapshots
from probatum.operators.resolve import duplicate_keys


class DuplicateKeys(ValueError):
    """A snapshot holds a key more than once, so records cannot be told apart."""


@dataclass
class Comparison:
    changes: DataFrame
    suspicious: DataFrame

    def volume(self) -> DataFrame:
        """``(kind, n)``, zero where nothing changed that way."""
        spark = self.changes.sparkSession
        zeros = spark.createDataFrame([(k, 0) for k in ("added", "edited", "removed")], "kind string, n bigint")
        counted = self.changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
        return counted.unionByName(zeros).groupBy("kind").agg(F.sum("n").alias("n"))


def compare(before: dict[str, DataFrame], after: dict[str, DataFrame], check_keys: bool = True) -> Comparison:
    """All collections present in both snapshots, in one frame each of changes and suspicions."""
    names = [n for n in fixed.TITLE_FIELD if n in before and n in after]
    if check_keys:
        for side in (before, after):
            twice = reduce(DataFrame.unionByName, [
                duplicate_keys(side[n]).select(F.lit(n).alias("collection"), "slug") for n in names]).limit(20).collect()
            if twice:
                raise DuplicateKeys(", ".join(f"{r.collection}/{r.slug}" for r in twice))
    of = lambda f: reduce(DataFrame.unionByName, [f(n, before[n], after[n], fixed.TITLE_FIELD[n]) for n in names])
    return Comparison(of(snapshots.changes), of(snapshots.suspicious))
