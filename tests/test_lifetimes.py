"""Written tables live until their last reader is written."""

import uuid
from pathlib import Path

import pytest

from probatum import lifetimes


@pytest.fixture
def shared(spark, folder, monkeypatch):
    lifetimes.sweep(spark)
    monkeypatch.setattr(lifetimes, "shared_folder", lambda spark, name: f"file://{folder}/{name}-{uuid.uuid4().hex}")
    yield Path(folder)
    lifetimes.sweep(spark)


def names(shared):
    return sorted(p.name.rpartition("-")[0] for p in shared.iterdir())


def test_counted_readers(spark, shared):
    with lifetimes.scope(spark) as tables:
        a = lifetimes.written(spark.range(10), "a", readers=2)
        b = lifetimes.written(a.where("id > 2"), "b")
        assert names(shared) == ["a", "b"]
        c = lifetimes.written(a.join(b, "id").unionByName(a), "c", readers=1)  # reads a twice: one reader
        assert names(shared) == ["b", "c"]
        d = lifetimes.written(c.groupBy().count(), "d")
        assert names(shared) == ["b", "d"]
        tables.keep(d)
    assert names(shared) == ["d"] and d.first()[0] == 17
    lifetimes.sweep(spark)
    assert names(shared) == []


def test_scopes_hand_on_what_results_read(spark, shared):
    def inner(df):
        with lifetimes.scope(spark) as tables:
            x = lifetimes.written(df, "x")
            y = lifetimes.written(x, "y")
            tables.keep(y)
        return y.select((y.id + 1).alias("id"))
    with lifetimes.scope(spark) as tables:
        first = inner(spark.range(5))
        assert names(shared) == ["y"]
        z = lifetimes.written(inner(first), "z")
        assert names(shared) == ["y", "y", "z"]
        lifetimes.release(first)
        assert names(shared) == ["y", "z"]
        tables.keep(z)
    assert names(shared) == ["z"] and sorted(r.id for r in z.collect()) == [2, 3, 4, 5, 6]


def test_failure_leaves_nothing(spark, shared):
    with pytest.raises(ZeroDivisionError), lifetimes.scope(spark):
        lifetimes.written(spark.range(3), "a")
        spark.range(2).write.saveAsTable(lifetimes.catalog_table(spark, "lifetime_case"))
        raise ZeroDivisionError
    assert names(shared) == [] and not spark.catalog.tableExists("lifetime_case")


def test_sweep_spares_what_is_named(spark, shared):
    a, b = lifetimes.written(spark.range(3), "a"), lifetimes.written(spark.range(4), "b")
    lifetimes.sweep(spark, b.where("id > 1"))
    assert names(shared) == ["b"] and b.count() == 4
    assert a.schema == b.schema
