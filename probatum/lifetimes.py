"""Lifetimes of written tables: deleted once what follows from them is itself on disk.

Operators that take several steps write their intermediate tables to the shared folder.
Such a table is needed until its last reader is written: from then on a lost executor is
answered from the reader's files.  A scope knows the tables written inside it, takes those
that a written frame reads from the frame's input files, counts readers, and deletes by the
Hadoop file system of the folder.  What a scope gives back stays with the scope around it,
or with the session until ``sweep``.
"""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_current: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)
_session: dict[str, Scope] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares.

    The folder is ``spark.checkpoint.dir``.  A local session without that setting (tests)
    gets a temporary one; a cluster without it is refused.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault(context.applicationId, tempfile.mkdtemp(prefix="shared-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; one that is gone already is no error."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(java, True)


def _plain(path: str) -> str:
    return unquote(urlparse(path).path)


class Scope:
    """The tables written by one job; use it through ``scope``."""

    def __init__(self, spark: SparkSession, outer: Scope | None):
        self.spark, self.outer = spark, outer
        #: path of each table that exists, with the readers that are still to be written (None: not counted)
        self.tables: dict[str, int | None] = {}
        #: tables of the catalog, dropped with the scope
        self.named: set[str] = set()

    def _holder(self, path: str) -> Scope | None:
        return self if path in self.tables else self.outer._holder(path) if self.outer else None

    def read_by(self, df: DataFrame) -> set[str]:
        """The tables of this scope and those around it that a frame reads."""
        folders = {_plain(f).rpartition("/")[0] for f in df.inputFiles()}
        scope, found = self, set()
        while scope:
            found |= {p for p in scope.tables if _plain(p) in folders}
            scope = scope.outer
        return found

    def written(self, df: DataFrame, name: str, readers: int | None = None) -> DataFrame:
        reads = {p for p in self.read_by(df) if self._holder(p).tables[p] is not None}
        path = shared_folder(self.spark, name)
        df.write.parquet(path)
        self.tables[path] = readers
        for p in reads:
            holder = self._holder(p)
            holder.tables[p] -= 1
            if holder.tables[p] <= 0:
                delete(self.spark, p)
                del holder.tables[p]
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *frames: DataFrame) -> None:
        """Delete the tables that these frames read, in this scope or one around it."""
        for p in set().union(*map(self.read_by, frames)):
            delete(self.spark, p)
            del self._holder(p).tables[p]

    def keep(self, *frames: DataFrame) -> None:
        """The tables that these frames read go to the scope around this one (the session's, where there is none)."""
        outer = self.outer or _of_session(self.spark)
        for df in frames:
            for p in self.read_by(df):
                if p in self.tables:
                    outer.tables[p] = None
                    del self.tables[p]

    def close(self) -> None:
        for name in sorted(self.named):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in list(self.tables):
            delete(self.spark, path)
        self.tables.clear()
        self.named.clear()


def _of_session(spark: SparkSession) -> Scope:
    return _session.setdefault(spark.sparkContext.applicationId, Scope(spark, None))


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables written inside are deleted at the end, but for those that ``keep`` was told of.

        with scope(spark) as tables:
            a = written(first, "a", readers=1)
            b = written(second(a), "b")            # a is deleted here
            result = third(b)
            tables.keep(result)                    # b outlives the scope
    """
    here = Scope(spark, _current.get())
    token = _current.set(here)
    try:
        yield here
    finally:
        _current.reset(token)
        here.close()


def written(df: DataFrame, name: str, readers: int | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and kept when executors are lost.

    ``readers`` is how many later ``written`` calls read it; it is deleted with the last.
    Without a number it lives as long as its scope, outside any scope until ``sweep``.
    """
    return (_current.get() or _of_session(df.sparkSession)).written(df, name, readers)


def release(*frames: DataFrame) -> None:
    """Delete the written tables that these frames read; nothing else may still need them."""
    (_current.get() or _of_session(frames[0].sparkSession)).release(*frames)


def catalog_table(spark: SparkSession, name: str) -> str:
    """``name``, to be dropped with the scope around (outside any, with ``sweep``)."""
    (_current.get() or _of_session(spark)).named.add(name)
    return name


def sweep(spark: SparkSession, *but: DataFrame) -> None:
    """Delete all tables that finished jobs of this session have left for their results, but for those that ``but`` read."""
    session = _of_session(spark)
    kept = {p: session.tables.pop(p) for p in set().union(*map(session.read_by, but))}
    session.close()
    session.tables.update(kept)
