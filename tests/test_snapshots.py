import pytest

from probatum.operators import snapshots as D
from probatum.plans.compare import DuplicateKeys, compare
from tests.records import frame


def people(spark, *rows):
    return {"people": frame(spark, "people", *rows)}


def test_nothing_changes_against_itself(spark):
    same = people(spark, dict(slug="a"), dict(slug="b", assessment="x"))
    result = compare(same, same)
    assert result.changes.count() == 0 and result.suspicious.count() == 0
    assert {r.kind: r.n for r in result.volume().collect()} == {"added": 0, "edited": 0, "removed": 0}


def test_kinds_of_change(spark):
    was = people(spark, dict(slug="kept"), dict(slug="gone"), dict(slug="moved", category=["a", "b"]))
    now = people(spark, dict(slug="kept"), dict(slug="new"), dict(slug="moved", category=["b", "a"]))
    rows = {r.slug: r.kind for r in compare(was, now).changes.collect()}
    assert rows == {"gone": "removed", "new": "added", "moved": "edited"}
    fields = D.edited_fields(was["people"], now["people"], D.changed_keys(was["people"], now["people"])).collect()
    assert [(f.slug, f.field) for f in fields] == [("moved", "category")]


@pytest.mark.parametrize("was,now,severity,message", [
    (dict(assessment="Decisive"), dict(assessment="Minor"), "warn", 'Assessment is another now: "Test Person"'),
    (dict(assessment="Decisive"), dict(assessment=None), "error", 'Assessment taken away: "Test Person"'),
    (dict(contestedPoints="x"), dict(contestedPoints=None), "error", 'Contested points gone from "Test Person"'),
    (dict(oneLine="about 300 men"), dict(oneLine="300 men"), "warn", 'Hedge "about" removed from beside a number on "Test Person"'),
])
def test_suspicious_edits(spark, was, now, severity, message):
    rows = compare(people(spark, was), people(spark, now)).suspicious.collect()
    assert [(r.severity, r.message) for r in rows] == [(severity, message)]


def test_expanded_prose_is_fine(spark):
    rows = compare(people(spark, dict(oneLine="about 300 men")), people(spark, dict(oneLine="about 300 men and more"))).suspicious.collect()
    assert rows == []


def test_deleted_records_and_moved_references(spark):
    was = {"sources": frame(spark, "sources", dict(slug="a"), dict(slug="b"))}
    now = {"sources": frame(spark, "sources", dict(slug="a", archivalReference="SHD 3H"))}
    rows = compare(was, now).suspicious.collect()
    assert sorted((r.severity, r.message) for r in rows) == [
        ("error", 'Record deleted: "Test Source"'), ("warn", 'Other archival reference, same verification: "Test Source"')]
    moved = {"sources": frame(spark, "sources", dict(slug="a", archivalReference="x", verification="Catalogue verified"), dict(slug="b"))}
    assert compare(was, moved).suspicious.count() == 0


def test_repeated_keys_are_refused(spark):
    twice = people(spark, dict(slug="a"), dict(slug="a"))
    with pytest.raises(DuplicateKeys):
        compare(twice, twice)


def test_fields_of_either_side(spark):
    was = spark.createDataFrame([("a", "1", "x", "h1"), ("b", "2", None, "h1"), ("c", "3", "y", "h1")], "slug string, n string, gone string, hash string")
    now = spark.createDataFrame([("a", "1", None, "h2"), ("b", "2", "z", "h2"), ("c", "3", "w", "h1")], "slug string, n string, `came.in` string, hash string")
    keys = D.changed_keys(was, now)
    assert sorted((r.slug, r.kind) for r in keys.collect()) == [("a", "edited"), ("b", "edited")]
    rows = {(r.slug, r.field): (r.before, r.after) for r in D.edited_fields(was, now, keys).collect()}
    assert rows == {("a", "gone"): ("x", None), ("a", "came.in"): (None, None), ("b", "gone"): (None, None), ("b", "came.in"): (None, "z")}


def test_a_moved_hash_alone_is_no_edit(spark):
    was = spark.createDataFrame([("a", "1", "h1", "mon"), ("b", "2", "h1", "mon"), ("c", "3", "h1", "mon")], "slug string, n string, hash string, lastEdited string")
    now = spark.createDataFrame([("a", "1", "h2", "tue"), ("b", "4", "h2", "tue"), ("d", "3", "h1", "tue")], "slug string, n string, hash string, lastEdited string")
    assert sorted((r.slug, r.kind) for r in D.moved_keys(was, now).collect()) == [("a", "moved"), ("b", "moved"), ("c", "removed"), ("d", "added")]
    keys = D.changed_keys(was, now)
    assert sorted((r.slug, r.kind) for r in keys.collect()) == [("b", "edited"), ("c", "removed"), ("d", "added")]
    fields = D.edited_fields(was, now, D.moved_keys(was, now)).collect()
    assert [(r.slug, r.field, r.before, r.after) for r in fields] == [("b", "n", "2", "4")]
    assert D.changed_keys(was.limit(0), now.limit(0)).collect() == []


def test_an_assessment_column_that_went_is_told(spark):
    was = people(spark, dict(slug="a", assessment="Decisive"))
    now = {"people": people(spark, dict(slug="a"))["people"].drop("assessment")}
    rows = compare(was, now).suspicious.collect()
    assert [(r.severity, r.field, r.message) for r in rows] == [("error", "assessment", 'Assessment taken away: "Test Person"')]
