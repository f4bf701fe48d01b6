"""Record fixtures that pass every rule; tests change one field at a time."""

PEOPLE = ("slug string, notionId string, url string, name string, aliasesRaw string, aliases array<string>, born string, died string, "
          "category array<string>, region array<string>, phase array<string>, dossierStatus string, evidenceBase string, impact string, "
          "assessment string, lastReviewed string, oneLine string, contestedPoints string, events array<string>, "
          "relationships array<string>, body string")
SOURCES = ("slug string, title string, author string, date string, publisher string, language array<string>, tier string, "
           "sourceUrl string, archivalReference string, verification string, biasNotes string, covers string")
ARCHIVES = ("slug string, institution string, country string, city string, fonds string, coveringDates string, holdings string, "
            "whatItCanSettle string, access string, digitised string, verification string, priority string, archiveUrl string")
EVENTS = ("slug string, event string, start string, end string, location string, phase string, type array<string>, "
          "dossierStatus string, summary string, mainDispute string, people array<string>, body string")
RELATIONSHIPS = ("slug string, label string, from string, to string, fromName string, toName string, relation string, period string, "
                 "evidence string, evidenceStrength string")
PAGES = "slug string, title string, body string"
TYPES = "collection string, field string, type string"

DEFAULTS = {
    "people": (PEOPLE, dict(slug="test-person", name="Test Person", aliases=[], born="1836 (conventional). Some reference works give 1857",
                            died="not established", category=["Tribal leader"], region=["Middle Atlas"], phase=["IV 1912-1921"],
                            dossierStatus="Stub", evidenceBase="Thin - encyclopedic leads only", events=[], relationships=[])),
    "sources": (SOURCES, dict(slug="test-source", title="Test Source", language=["French"], tier="ACADEMIC",
                              verification="Cited by named scholar", archivalReference="n/a")),
    "archives": (ARCHIVES, dict(slug="test-archive", institution="Test Archive", country="France", fonds="Série X",
                                digitised="On-site only", verification="Catalogue verified", priority="2 - structural")),
    "events": (EVENTS, dict(slug="test-event", event="Test Event", start="1914-11-13", phase="IV 1912-1921", type=["Battle"],
                            dossierStatus="Stub", people=["test-person"])),
    "relationships": (RELATIONSHIPS, dict(slug="test-rel", label="a to b", **{"from": "test-person", "to": "test-person-2"},
                                          fromName="A", toName="B", relation="opposed", evidenceStrength="Documented")),
    "pages": (PAGES, dict(slug="test-page", title="Test Page", body="")),
    "property_types": (TYPES, dict(collection="people", field="Born", type="rich_text")),
}


def frame(spark, collection, *changes):
    """Rows of a collection, each the default row with some fields changed."""
    schema, default = DEFAULTS[collection]
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [tuple({**default, **c}.get(n) for n in names) for c in changes]
    return spark.createDataFrame(rows, ", ".join("`" + c.split()[0] + "` " + " ".join(c.split()[1:]) for c in schema.split(", ")))


def snapshot(spark, **collections):
    """A snapshot of the given rows; a collection not named is empty."""
    return {c: frame(spark, c, *collections.get(c, [])) for c in DEFAULTS}
