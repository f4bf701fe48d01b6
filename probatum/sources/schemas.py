"""Schemas of the collections and their cleaning specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions.clean import external_id, text_list, text_or_null
from probatum.functions.names import parse_aliases, split_aliases
from probatum.functions.text import derived_year

# collection → (title column, [(raw column, field, kind)])
# kinds: text, verbatim, list, ids, first_id
COLLECTIONS = {
    "people": ("Name", [
        ("Name", "name", "verbatim"), ("Aliases & spellings", "aliasesRaw", "text"), ("Born", "born", "text"),
        ("Died", "died", "text"), ("Category", "category", "list"), ("Region", "region", "list"),
        ("Phase", "phase", "list"), ("Dossier status", "dossierStatus", "text"),
        ("Evidence base", "evidenceBase", "text"), ("Impact", "impact", "text"), ("One-line", "oneLine", "text"),
        ("Contested points", "contestedPoints", "text"), ("Assessment (signed opinion)", "assessment", "text"),
        ("Last reviewed", "lastReviewed", "text"), ("__body", "body", "text")]),
    "events": ("Event", [
        ("Event", "event", "verbatim"), ("Start", "start", "text"), ("End", "end", "text"),
        ("Location", "location", "text"), ("Phase", "phase", "text"), ("Type", "type", "list"),
        ("Dossier status", "dossierStatus", "text"), ("Summary", "summary", "text"),
        ("Main dispute", "mainDispute", "text"), ("People involved", "peopleIds", "ids"), ("__body", "body", "text")]),
    "sources": ("Title", [
        ("Title", "title", "verbatim"), ("Author / producer", "author", "text"), ("Date", "date", "text"),
        ("Institution / publisher", "publisher", "text"), ("Language", "language", "list"), ("Tier", "tier", "text"),
        ("URL", "sourceUrl", "text"), ("Archival reference", "archivalReference", "text"),
        ("Verification", "verification", "text"), ("Bias notes", "biasNotes", "text"), ("Covers", "covers", "text")]),
    "archives": ("Institution", [
        ("Institution", "institution", "verbatim"), ("Country", "country", "text"), ("City", "city", "text"),
        ("Fonds / series", "fonds", "text"), ("Covering dates", "coveringDates", "text"),
        ("Holdings", "holdings", "text"), ("What it can settle", "whatItCanSettle", "text"),
        ("Access", "access", "text"), ("Digitised", "digitised", "text"), ("Verification", "verification", "text"),
        ("Priority", "priority", "text"), ("URL", "archiveUrl", "text"), ("Search terms to use", "searchTerms", "text"),
        ("Not yet searched", "notYetSearched", "text"), ("Language", "language", "list"),
        ("Related people", "relatedPeopleIds", "ids"), ("Related events", "relatedEventIds", "ids")]),
    "relationships": ("Relationship", [
        ("Relationship", "label", "verbatim"), ("From", "fromId", "first_id"), ("To", "toId", "first_id"),
        ("Relation", "relation", "text"), ("Period", "period", "text"), ("Evidence", "evidence", "text"),
        ("Evidence strength", "evidenceStrength", "text")]),
    "places": ("Place", [
        ("Place", "place", "verbatim"), ("Other names", "otherNames", "text"), ("Region", "region", "text"),
        ("Zone", "zone", "text"), ("Why it matters", "whyItMatters", "text"), ("Tribes", "tribes", "text"),
        ("Military presence", "militaryPresence", "text")]),
    "groups": ("Group", [
        ("Group", "group", "verbatim"), ("Other names", "otherNames", "text"), ("Type", "type", "text"),
        ("Language", "language", "list"), ("Region", "region", "text"),
        ("Political position", "politicalPosition", "text"), ("Notes", "notes", "text")]),
    "claim-records": ("Claim", [
        ("Claim", "claim", "verbatim"), ("Confidence", "confidence", "text"), ("Evidence layer", "evidenceLayer", "text"),
        ("Phase", "phase", "text"), ("What the document says", "whatTheDocumentSays", "text"),
        ("Interpretation", "interpretation", "text"), ("Counter-evidence", "counterEvidence", "text"),
        ("Why sources disagree", "whySourcesDisagree", "text"), ("Archival reference", "archivalReference", "text"),
        ("Primary evidence", "primaryEvidenceIds", "ids"), ("Counter-evidence sources", "counterEvidenceIds", "ids"),
        ("Archive", "archiveIds", "ids"), ("People", "peopleIds", "ids"), ("Events", "eventIds", "ids"),
        ("Disputes", "disputeIds", "ids"), ("Open questions", "openQuestionIds", "ids"),
        ("Last reviewed", "lastReviewed", "text")]),
    "dispute-records": ("Dispute", [
        ("Dispute", "dispute", "verbatim"), ("French position", "french", "text"), ("Spanish position", "spanish", "text"),
        ("Moroccan position", "moroccan", "text"), ("Other position", "other", "text"),
        ("Current assessment", "currentAssessment", "text"), ("Why the sources disagree", "whySourcesDisagree", "text"),
        ("Status", "status", "text"), ("Phase", "phase", "text"), ("People", "peopleIds", "ids"),
        ("Events", "eventIds", "ids"), ("Related claims", "claimIds", "ids")]),
    "open-questions": ("Question", [
        ("Question", "question", "verbatim"), ("What we know", "whatWeKnow", "text"),
        ("Missing evidence", "missingEvidence", "text"), ("Documents requested", "documentsRequested", "text"),
        ("Why we don't know", "whyWeDontKnow", "text"), ("Research status", "researchStatus", "text"),
        ("Phase", "phase", "text"), ("Archives likely to hold it", "archiveIds", "ids"), ("People", "peopleIds", "ids"),
        ("Events", "eventIds", "ids"), ("Related claims", "claimIds", "ids")]),
    "bibliography": ("Entry", [
        ("Entry", "entry", "text"), ("Type", "type", "text"), ("Author(s)", "authors", "text"), ("Year", "year", "text"),
        ("Identifier", "identifier", "text"), ("Catalogue/access URL", "url", "text"), ("Language", "language", "list"),
        ("Notes", "notes", "text")]),
}

# collection → {link label: id list column}
RELATIONS = {
    "claim-records": {"primaryEvidence": "primaryEvidenceIds", "counterEvidenceSources": "counterEvidenceIds",
                      "archives": "archiveIds", "people": "peopleIds", "events": "eventIds", "disputes": "disputeIds",
                      "openQuestions": "openQuestionIds"},
    "dispute-records": {"people": "peopleIds", "events": "eventIds", "claims": "claimIds"},
    "open-questions": {"archives": "archiveIds", "people": "peopleIds", "events": "eventIds", "claims": "claimIds"},
}
# relations whose unresolved members are dropped rather than refused
LENIENT_RELATIONS = {"archives": {"relatedPeople": "relatedPeopleIds", "relatedEvents": "relatedEventIds"},
                     "events": {"people": "peopleIds"}}


def raw_schema(collection: str) -> str:
    """DDL of a raw collection: display-name columns, every value as text."""
    columns = [raw for raw, _, _ in COLLECTIONS[collection][1]]
    return ", ".join(f"`{c}` string" for c in dict.fromkeys(["url", *columns, "_corrupt_record"]))


def project(collection: str, raw: DataFrame, tagged_aliases: bool = True) -> DataFrame:
    """The typed projection of a raw collection; a missing column gives null or [].

    ``tagged_aliases`` keeps tradition and script with each alias; off, aliases are the
    plain spellings the matcher compares.
    """
    have = set(raw.columns)
    col = lambda c: F.col(f"`{c}`") if c in have else F.lit(None).cast("string")
    listed = lambda c: (F.coalesce(col(c), F.array().cast("array<string>"))
                        if dict(raw.dtypes).get(c, "").startswith("array") else text_list(col(c)))
    address = F.col("url") if "url" in have else F.lit(None).cast("string")
    ids = lambda c: F.filter(F.transform(listed(c), external_id), lambda v: v.isNotNull())
    kinds = {"text": lambda c: text_or_null(col(c)), "verbatim": lambda c: F.coalesce(col(c), F.lit("")),
             "list": listed, "ids": ids, "first_id": lambda c: external_id(F.get(listed(c), F.lit(0)))}
    extra = [c for c in ("ord", "slug") if c in have]
    out = raw.select(*extra, external_id(address).alias("notionId"),
                     *[kinds[kind](source).alias(field) for source, field, kind in COLLECTIONS[collection][1]])
    if collection == "people":
        aliases = parse_aliases(F.col("aliasesRaw")) if tagged_aliases else split_aliases(F.col("aliasesRaw"))
        out = (out.withColumn("aliases", aliases).withColumn("_derivedBornYear", derived_year(F.col("born")))
               .withColumn("_derivedDiedYear", derived_year(F.col("died"))))
    if collection in ("places", "groups"):
        out = out.withColumn("aliases", parse_aliases(F.col("otherNames")))
    if collection == "dispute-records":
        parties = ["french", "spanish", "moroccan", "other"]
        out = out.withColumn("positions", F.struct(*parties)).drop(*parties)
    return out
