import json
import os

import pytest
from pyspark.sql import functions as F

from probatum.sources import collections as S
from probatum.sources import documents as D
from probatum.sources.properties import from_view, read_property, side_table


def test_raw_collections(spark, folder):
    with open(f"{folder}/people.json", "w") as f:
        json.dump([{"Name": "A", "Category": ["x", "y"]}, {"Name": "B"}], f)
    df = S.read_raw(spark, folder, "people")
    assert [r.Name for r in df.orderBy("Name").collect()] == ["A", "B"]
    assert json.loads(df.where("Name = 'A'").first().Category) == ["x", "y"]
    assert S.read_raw(spark, folder, "pages") is None
    with pytest.raises(FileNotFoundError):
        S.read_raw(spark, folder, "events")


def test_all_collections_or_none(spark, folder):
    good = spark.range(3).withColumnRenamed("id", "slug")
    assert S.write_collections({"a": good, "b": good}, folder) == {"a": 3, "b": 3}
    bad = good.withColumn("slug", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception):
        S.write_collections({"a": good.limit(1), "b": bad}, folder)
    assert S.read_collections(spark, folder, ["a"])["a"].count() == 3
    assert S.write_collections({"a": good.limit(1)}, folder) == {"a": 1}
    assert S.read_collections(spark, folder, ["a"])["a"].count() == 1


def test_dated_snapshots(spark, folder):
    people = lambda n: {"people": spark.range(n).withColumnRenamed("id", "slug")}
    S.write_snapshot(people(2), folder, "2026-08-01")
    with pytest.raises(ValueError):
        S.load_snapshot(spark, folder, ["people"], age=2)
    S.write_snapshot(people(3), folder, "2026-08-02")
    S.write_snapshot(people(5), folder, "2026-08-02")  # the same day replaces
    assert [(str(r.snapshot_date), r.age) for r in S.list_snapshots(spark, folder).orderBy("age").collect()] == [("2026-08-02", 1), ("2026-08-01", 2)]
    count = lambda **k: S.load_snapshot(spark, folder, ["people"], **k)["people"].count()
    assert (count(), count(age=2), count(date="2026-08-01")) == (5, 2, 2)
    with pytest.raises(ValueError):
        count(date="2020-01-01")


def test_property_types(spark):
    rows = S.property_types({"people": spark.range(1)}).collect()
    assert [tuple(r) for r in rows] == [("people", "id", "bigint")]


def test_markdown_and_html_trees(spark, folder):
    os.makedirs(f"{folder}/x/y")
    for name, text in {"x/a.mdx": "---\nslug: 'aa'\n---\n<Note/>hello\n", "x/y/b.mdx": "plain", "x/c.html": "<p>1</p>", "x/y/d.html": "<p>2</p>"}.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    docs = D.read_markdown(spark, folder)
    assert {(r.slug, r.body) for r in docs.collect()} == {("aa", "<Note/>hello\n"), ("b", "plain")}
    assert {(r.slug, r.body) for r in D.prose_bodies(docs).collect()} == {("aa", "hello"), ("b", "plain")}
    assert sorted(r.html for r in D.read_html(spark, folder).collect()) == ["<p>1</p>", "<p>2</p>"]


def test_written_bodies_read_back(spark, folder):
    bodies = spark.createDataFrame([("people", "a", 'A "b"', "text"), ("people", "b", "B", "  "), ("events", "c", "C", "more")],
                                   "collection string, slug string, title string, body string")
    D.write_bodies(bodies, f"{folder}/out")
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert {(r.collection, r.slug) for r in rows} == {("people", "a"), ("events", "c")}
    assert [r.text for r in rows if r.slug == "a"] == ['---\nslug: "a"\ntitle: "A \\"b\\""\n---\ntext\n']


def test_blocks_become_markdown(spark):
    runs = [("bold", False, True, False, None), (" and ", False, False, False, None), ("code", True, True, False, "u"), ("link", False, False, True, "http://x")]
    text = spark.createDataFrame([(runs,)], f"r {D.RICH}").select(D.rich_text(F.col("r"))).first()[0]
    assert text == "**bold** and `code`[*link*](http://x)"
    blocks = spark.createDataFrame([(1, "heading_2", "T", 0), (2, "paragraph", " ", 0), (3, "bulleted_list_item", "i", 1), (4, "callout", "c", 0),
                                    (5, "code", "x", 0), (6, "divider", "", 0), (7, "unknown", "z", 0)], "pos long, kind string, text string, depth int")
    rendered = blocks.withColumn("doc", F.lit("d")).withColumn("md", D.render_block(F.col("kind"), F.col("text"), F.col("depth")))
    assert D.assemble(rendered, ["doc"], "pos", "md").first().body == "## T\n\n  - i\n\n> c\n\n```\nx\n```\n\n---"
    row = spark.createDataFrame([(["a|b", None],)], "c array<string>").select(D.table_row(F.col("c"), F.lit(3))).first()[0]
    assert row == "| a\\|b |  |  |"


@pytest.mark.parametrize("prop,text,items", [
    ({"type": "title", "title": [{"plain_text": "a"}, {"plain_text": "b"}]}, "ab", None), ({"type": "rich_text", "rich_text": []}, None, None),
    ({"type": "title", "title": []}, "", None), ({"type": "select", "select": None}, None, None), ({"type": "select", "select": {"name": "x"}}, "x", None),
    ({"type": "multi_select", "multi_select": [{"name": "x"}]}, None, ["x"]), ({"type": "relation", "relation": [{"id": "1"}]}, None, ["1"]),
    ({"type": "date", "date": {"start": "2020-01-01"}}, "2020-01-01", None), ({"type": "number", "number": 3}, "3", None), ({"type": "number", "number": 1.5}, "1.5", None),
    ({"type": "checkbox", "checkbox": False}, "false", None), ({"type": "people", "people": [{"id": "u"}]}, None, ["u"]), ({"type": "formula"}, None, None)])
def test_properties(spark, prop, text, items):
    row = spark.createDataFrame([(json.dumps(prop),)], "p string").select(read_property(F.col("p")).alias("v")).first().v
    assert (row.text, row["items"]) == (text, items)


def test_view_rows(spark):
    df = spark.createDataFrame([('["a"]', " ", "2020-01-01"), ("", "x", "")], "`people` string, note string, `date:When:start` string")
    rows = from_view(df, arrays=("people", "tags"), dates={"When": "when", "Other": "other"}).collect()
    assert [tuple(r) for r in rows] == [(["a"], None, "2020-01-01", None, []), ([], "x", None, None, [])]


def test_side_tables(spark, folder):
    with open(f"{folder}/t.json", "w") as f:
        json.dump({"_comment": "c", "pairs": [{"a": "x", "b": "y"}]}, f)
    assert [tuple(r) for r in side_table(spark, f"{folder}/t.json", "pairs").collect()] == [("x", "y")]
