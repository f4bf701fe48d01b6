from pyspark.sql import functions as F

from probatum.operators import claims as C
from probatum.operators.tallies import headings
from probatum.sources.documents import assemble

BODY = """## First *part*
- **Established:** One `PRIMARY_ARCHIVAL` and ACADEMIC fact.
```
**Disputed:** in a fence
## not a heading
```
**Well established.** Two
### Second
**Withheld rather than unknown:** The file
**Status:** open, still classified
**Unknown:**
**Somebody:** says
**alleged and unproven:** [three](http://x) ARCHIVAL REFERENCE NOT YET VERIFIED
"""


def test_extraction(spark):
    docs = spark.createDataFrame([("a", BODY), ("b", "no claims"), ("c", "```\n**Disputed:** open fence")], "slug string, body string")
    rows = C.extract_claims(docs).orderBy("id").collect()
    assert [(r.id, r.section, r.leadIn, r.status, r.withheld) for r in rows] == [
        ("a-0", "First part", "Established", "Established", False), ("a-1", "First part", "Well established", "Established", False),
        ("a-2", "Second", "Withheld rather than unknown", None, True), ("a-3", "Second", "Status", None, True),
        ("a-4", "Second", "Alleged and unproven", "Disputed", False)]
    assert rows[0].tiers == ["PRIMARY_ARCHIVAL", "ACADEMIC"] and rows[0].text == "One PRIMARY_ARCHIVAL and ACADEMIC fact."
    assert rows[4].unverifiedRef and rows[4].text == "three ARCHIVAL REFERENCE NOT YET VERIFIED"


def test_withheld_is_a_flag_and_ungraded_a_value(spark):
    docs = spark.createDataFrame([("a", BODY)], "slug string, body string")
    counts = {r.status: (r.n, r.withheld) for r in C.status_counts(C.extract_claims(docs)).collect()}
    assert counts == {"Established": (2, 0), "Ungraded": (2, 2), "Disputed": (1, 0)}


def test_hosts(spark):
    docs = spark.createDataFrame([("a", "**Established:** x")], "slug string, body string")
    hosts = spark.createDataFrame([("a", "A", "person", "/people/a")], "slug string, title string, kind string, url string")
    people = spark.createDataFrame([("a", ["IV", "V"])], "slug string, phase array<string>")
    row = C.with_host(C.extract_claims(docs), hosts, people).first()
    assert (row.url, row.host, row.phase) == ("/people/a#claim-0", "A", "IV")


def test_only_marker_lines_are_shuffled(spark):
    docs = spark.createDataFrame([("a", "line\n" * 50 + BODY)], "slug string, body string")
    assert C.marker_lines(docs).count() == 12


def test_contents_lists(spark):
    docs = spark.createDataFrame([("a", BODY)], "slug string, body string")
    assert [(r.depth, r.title) for r in headings(docs).orderBy("line_no").collect()] == [(2, "First part"), (3, "Second")]


def test_pages_carry_fences_sections_and_counts(spark):
    """A document of 25,000 blocks: fences and headings stay open over the borders of pages."""
    line = (F.when(F.col("id").isin(3, 6, 9_990, 10_004, 19_999, 20_001), "```").when(F.col("id") == 9_985, "## In force, *over* the border")
            .when(F.col("id") == 10_000, "## In code").when(F.col("id") == 21_000, "### ").when(F.col("id") == 5, "## Fenced")
            .when(F.col("id") % 7 == 0, F.concat(F.lit("**Established.** No. "), "id")).otherwise(F.concat(F.lit("line "), "id")))
    blocks = spark.range(25_000).select(F.lit("long").alias("slug"), "id", line.alias("md")).unionByName(
        spark.range(40).select(F.lit("short").alias("slug"), "id", F.when(F.col("id") == 4, "## One").when(F.col("id") % 9 == 0, "- **Alleged:** x").alias("md")))
    whole = {tuple(map(str, r)) for r in C.extract_claims(assemble(blocks, ["slug"], "id", "md", page_size=100_000)).collect()}
    assert len(whole) > 1400 and {r[3] for r in whole} == {"In force, over the border", "", "One", "None"}
    for size in (10_000, 997):
        pages = assemble(blocks, ["slug"], "id", "md", page_size=size)
        got = C.extract_paged_claims(pages).collect()
        assert len(got) == len(whole) and {tuple(map(str, r)) for r in got} == whole


def test_every_page_border_gives_the_same_claims(spark):
    lines = ["**Established:** a", "## H", "```", "**Established:** no", "## no", "```", "**Alleged:** b", "```", "```", "### `I`", "", "**Established:** c", "```", "**Alleged:** open to the end"]
    blocks = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "slug string, id int, md string")
    whole = sorted(map(str, C.extract_claims(assemble(blocks, ["slug"], "id", "md", glue="\n")).collect()))
    assert len(whole) == 3
    for size in range(1, len(lines)):
        assert sorted(map(str, C.extract_paged_claims(assemble(blocks, ["slug"], "id", "md", glue="\n", page_size=size)).collect())) == whole
    assert C.extract_paged_claims(spark.createDataFrame([], "slug string, page int, body string")).collect() == []
