import pytest
from pyspark.sql import functions as F

from probatum.config import Settings, load_settings
from probatum.operators import graph
from probatum.operators.resolve import DanglingReference, with_unique_slug
from probatum.operators.tallies import facet_filter, health, tallies
from probatum.plans.build import build
from probatum.plans.compare import compare
from probatum.plans.report import json_lines, markdown
from probatum.plans.validate import GateFailed, assert_gate, run_rules, snapshot_tables, sort_findings
from probatum.operators.rules import ALL_RULES, Rule
from tests.records import snapshot


def address(n):
    return f"https://x/{n:032x}?v=1"


def raw(spark, **change):
    def rows(name, columns, values):
        return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "ord int, " + ", ".join(f"`{c}` string" for c in columns))

    refs = lambda *ns: "[" + ",".join(f'"{address(n)}"' for n in ns) + "]"
    out = {
        "people": rows("people", ["url", "Name", "Aliases & spellings", "Category", "Phase", "Born"], [
            (address(1), "Moha", "Fr.: 'Mouha'", '["Tribal leader"]', '["IV 1912-1921"]', "c. 1857"), (address(2), "Moha", None, "French civil", None, None)]),
        "events": rows("events", ["url", "Event", "People involved"], [(address(10), "Battle", refs(1, 99)), (address(11), "Treaty", None)]),
        "sources": rows("sources", ["url", "Title"], [(address(20), "Letters")]),
        "archives": rows("archives", ["url", "Institution", "Related people"], [(address(30), "SHD (Vincennes)", refs(2))]),
        "relationships": rows("relationships", ["url", "Relationship", "From", "To", "Evidence strength"], [
            (address(40), "a", refs(1), refs(2), "Documented"), (address(41), "loop", refs(1), refs(1), "Disputed")]),
        "claim-records": rows("claim-records", ["url", "Claim", "People", "Primary evidence", "Archive", "Disputes"], [
            (address(50), "One", refs(1), refs(20), refs(30), refs(60)), (address(51), "Two", refs(1, 2), None, None, refs(60)), (address(52), "Three", None, None, None, None)]),
        "dispute-records": rows("dispute-records", ["url", "Dispute", "French position", "Related claims", "People"], [
            (address(60), "Who", "They", refs(52), refs(1))]),
    }
    out.update(change)
    return out


def test_build(spark):
    docs = spark.createDataFrame([("moha", "Moha", "person", "/people/moha", "**Established:** x")], "slug string, title string, kind string, url string, body string")
    t = build(raw(spark), docs)
    assert sorted(r.slug for r in t["people"].collect()) == ["moha", "moha-2"]
    person = t["people"].where("slug = 'moha'").first()
    assert person["_derivedBornYear"] == 1857 and person.born == "c. 1857" and person.aliases[0].tradition == "Fr"
    links = {(r.collection, r.owner, r.label, r.slug) for r in t["links"].collect()}
    assert ("events", "battle", "people", "moha") in links and len([l for l in links if l[0] == "events"]) == 1
    back = {(r.collection, r.slug, r.label, r.owner) for r in t["back-links"].collect()}
    assert {("people", "moha", "claims", "one"), ("people", "moha-2", "archives", "shd-vincennes"), ("archives", "shd-vincennes", "claims", "one"),
            ("people", "moha", "disputes", "who"), ("people", "moha", "events", "battle")} <= back
    # the dispute lists Three; One and Two name it themselves
    members = t["dispute-claims"].orderBy("added", "pos").collect()
    assert [m.claim for m in members] == ["three", "one", "two"]
    degree = {r.id: r.degree for r in t["graph-nodes"].collect()}
    assert degree["person:moha"] == 1 + 2 + 2 and degree["claim:three"] == 2 and degree["source:letters"] == 1
    ends = {r.slug: sorted(x.relationship for x in t["relationship-links"].where(F.col("person") == r.slug).collect()) for r in t["people"].collect()}
    assert ends == {"moha": ["a", "loop"], "moha-2": ["a"]}
    assert t["claims"].first().url == "/people/moha#claim-0"
    assert t["search-index"].count() == 6


def test_dangling_references_stop_the_build(spark):
    claims = raw(spark)["claim-records"].withColumn("People", F.lit(f'["{address(77)}"]'))
    with pytest.raises(DanglingReference):
        build(raw(spark, **{"claim-records": claims}))
    edges = raw(spark)["relationships"].withColumn("To", F.lit(f'["{address(77)}"]'))
    with pytest.raises(DanglingReference):
        build(raw(spark, relationships=edges))


def test_slug_suffixes(spark):
    df = spark.createDataFrame([(1, "a 2"), (2, "A"), (3, "a"), (4, "á!"), (5, "")], "ord int, t string")
    slugs = {r.ord: r.slug for r in with_unique_slug(df, "t", "ord").collect()}
    assert slugs == {1: "a-2", 2: "a", 3: "a-2-x", 4: "a-3", 5: "untitled"}
    plain = {r.ord: r.slug for r in with_unique_slug(df, "t", "ord", guard_clash=False).collect()}
    assert plain[3] == "a-2"


def test_disputes_of_any_size_are_groups_with_exact_degrees(spark):
    members = spark.range(30).select(F.lit("d").alias("dispute"), F.col("id").cast("string").alias("claim"), F.col("id").alias("pos"))
    nodes = members.select(F.concat(F.lit("claim:"), "claim").alias("id"))
    groups = graph.contradictions(members)
    none = spark.createDataFrame([], "source string, target string, strength string")
    with_degrees = graph.degree(nodes, none, groups)
    assert {r.degree for r in with_degrees.collect()} == {29} and groups.count() == 30
    live, _, kept = graph.subgraph(with_degrees.where("id < 'claim:2'"), none, groups=groups)
    assert live.count() == 12 and {r.members for r in kept.collect()} == {12}


def test_tallies_are_zero_filled(spark):
    df = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "v string")
    assert {r.value: r.n for r in tallies(df, {"d": ("v", ["a", "b"])}).collect()} == {"a": 2, "b": 0, "z": 1, "(not recorded)": 1}
    full = spark.createDataFrame([("a",)], "v string")
    assert "(not recorded)" not in {r.value for r in tallies(full, {"d": ("v", ["a"])}).collect()}


def test_facets_match_whole_members(spark):
    df = spark.createDataFrame([("x", ["Rif", "High Atlas"], "moha"), ("y", ["Atlas"], "moha")], "s string, region array<string>, search string")
    assert [r.s for r in facet_filter(df, {"region": "Atlas", "s": ""}, "MOHA ").collect()] == ["y"]


def test_rules_are_isolated_selected_and_skipped(spark, folder):
    def fails(*_):
        raise RuntimeError("no plan")

    def fails_late(snap, *_):
        return ALL_RULES[0].run(snap, Settings()).withColumn("message", F.raise_error(F.lit("no action")).cast("string"))

    snap = snapshot(spark, people=[dict(dossierStatus="Almost done")], sources=[{}], archives=[{}], events=[{}], relationships=[{"to": "test-person"}])
    rules = [Rule("X1", "fails", fails), Rule("X2", "late", fails_late), *ALL_RULES[:1], *ALL_RULES[-2:]]
    result = run_rules(snap, Settings(), rules=rules, staging=folder)
    rows = sort_findings(result.findings).collect()
    assert [r.rule for r in rows] == ["R01", "X1", "X2"] and "no plan" in rows[1].message
    assert [s for s, _ in result.skipped] == ["R12", "R13"]
    assert run_rules(snap, Settings(), only=["R07"]).findings.count() == 0
    with pytest.raises(GateFailed):
        assert_gate(result.findings)
    assert assert_gate(result.findings, exit_zero=True) == 3


def test_snapshot_from_raw_is_lenient(spark):
    edges = raw(spark)["relationships"].withColumn("To", F.lit(f'["{address(77)}"]'))
    snap = snapshot_tables(raw(spark, relationships=edges))
    assert snap["relationships"].where("`to` IS NULL").count() == 2
    assert {r.slug: len(r.people) for r in snap["events"].collect()} == {"battle": 1, "treaty": 0}
    assert snap["people"].where("slug = 'moha'").first().aliases == ["Mouha"]


def test_reports(spark):
    snap = snapshot(spark, people=[dict(dossierStatus="Almost done", assessment="Big")], sources=[{}], archives=[{}], events=[{}], relationships=[{}], pages=[{}])
    after = snapshot(spark, people=[dict(slug="other")], sources=[{}], archives=[{}], events=[{}], relationships=[{}], pages=[{}])
    result = run_rules(snap, Settings(), only=["R01", "R08", "R12"])
    numbers = health(snap, "2026-08-16")
    lines = [r.line for r in markdown(result, numbers, "2026-08-16T00:00", "test", compare(snap, after)).collect()]
    text = "\n".join(lines)
    heads = [l for l in lines if l.startswith("#")]
    assert heads == ["# Integrity report — 2026-08-16", "## Suspicious changes since last run", "## Errors", "## Warnings", "## Notes", "## Not run",
                     "## Corpus health", "## Change volume"]
    assert '- **ERROR** `R01` dossierStatus = "Almost done" is outside the vocabulary\n  - `people / test-person / dossierStatus`' in text
    assert "- **R12** — needs a previous snapshot" in lines and "_None._" in lines and "%" not in text
    assert "- Added: 1" in lines and "- Removed: 1" in lines and "- `people` Test Person" in lines
    out = json_lines(result, numbers, "2026-08-16", "test", compare(snap, after)).orderBy("part").collect()
    assert '"takenAt":"2026-08-16"' in out[0].json and '"kind":"suspicious"' in out[1].json and len(out) == 1 + 1 + 2


def test_settings_merge_over_defaults():
    s = load_settings('{"severities": {"R04": "error"}, "stale_days": 30, "as_of": "2026-01-02"}')
    assert s.severity("R04") == "error" and s.severity("R10") == "info" and s.stale_days == 30 and s.as_of.isoformat() == "2026-01-02"


def test_streams_of_records(spark, folder):
    from probatum.streaming import validate_stream
    people = snapshot(spark, people=[dict(dossierStatus="Almost done"), dict(slug="b", born="1836-01-01")])["people"]
    people.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(people.schema).parquet(f"{folder}/in")
    query = validate_stream(stream, Settings()).writeStream.format("memory").queryName("found").option(
        "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.rule for r in spark.sql("SELECT rule FROM found").collect()) == ["R01", "R06"]
