"""The list of queries and of the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.records import RECORDS, with_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The parquet tables of one scale, and the record tables derived from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._known = spark, root, {}

    def __getattr__(self, name: str) -> DataFrame:
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in RECORDS:
                needs, sql = RECORDS[name]
                self._known[name] = self.spark.sql(sql, **{n: self[n] for n in needs})
            else:
                self._known[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._known[name]

    def get(self, name: str):
        return self[name]


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``sql`` may read the derived records named in ``uses``."""
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, root: build(Tables(spark, root))
        if sql is not None:
            ORACLE[name] = with_records(sql, uses)
        return build
    return add
