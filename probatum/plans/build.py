"""From raw collections to typed, linked tables with graph, timeline and search index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.functions.names import slugify
from probatum.operators import claims as claim_ops
from probatum.operators import graph, resolve, search
from probatum.operators.scale import cut_lineage
from probatum.sources.schemas import COLLECTIONS, LENIENT_RELATIONS, RELATIONS, project

# collection ← label of the links it receives, and the collection and label they come from
BACK_LINKS = [
    ("people", "claims", "claim-records", "people"), ("people", "disputes", "dispute-records", "people"),
    ("people", "events", "events", "people"), ("people", "archives", "archives", "relatedPeople"),
    ("events", "claims", "claim-records", "events"), ("events", "disputes", "dispute-records", "events"),
    ("events", "openQuestions", "open-questions", "events"), ("events", "archives", "archives", "relatedEvents"),
    ("archives", "claims", "claim-records", "archives"), ("archives", "openQuestions", "open-questions", "archives"),
]


def typed_collections(raw: dict[str, DataFrame], tagged_aliases: bool = True) -> dict[str, DataFrame]:
    """Typed records with their slug.

    Raw collections carry ``ord``, their ingest order, which decides slug suffixes.
    """
    out = {}
    for name, df in raw.items():
        if name not in COLLECTIONS:
            continue
        typed = project(name, df, tagged_aliases)
        title = dict((r, f) for r, f, _ in COLLECTIONS[name][1])[COLLECTIONS[name][0]]
        # every later step reads these tables again
        out[name] = cut_lineage(typed.withColumn("slug", slugify(F.col(title))) if name == "bibliography"
                                else resolve.with_unique_slug(typed, title, "ord"))
    return out


def _index(tables: dict[str, DataFrame]) -> DataFrame:
    title = lambda n: dict((r, f) for r, f, _ in COLLECTIONS[n][1])[COLLECTIONS[n][0]]
    named = [n for n in tables if n not in ("relationships", "bibliography")]
    return resolve.id_index({n: (tables[n], title(n)) for n in named})


def relation_links(tables: dict[str, DataFrame], index: DataFrame, strict: bool = True) -> DataFrame:
    """All links of all records: ``(collection, owner, label, pos, slug, name)``.

    With ``strict`` a claim, dispute or question whose relation does not resolve stops
    the build; archives and events drop such members.
    """
    def refs(specs):
        parts = [resolve.reference_rows(tables[c], column, label, as_address=False).withColumn("from_collection", F.lit(c))
                 for c, labels in specs.items() if c in tables for label, column in labels.items()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    kept = []
    for specs, required in ((RELATIONS, strict), (LENIENT_RELATIONS, False)):
        rows = refs(specs)
        if rows is None:
            continue
        resolved = resolve.resolve_references(rows, index)
        if required:
            resolve.require_resolved(resolved)
        kept.append(resolved.where("slug IS NOT NULL").select(
            F.col("from_collection").alias("collection"), "owner", "label", "pos", "slug", "name"))
    return reduce(DataFrame.unionByName, kept)


def all_back_links(links: DataFrame) -> DataFrame:
    """``(collection, slug, label, owner)``: who links to each record, once per pair."""
    table = links.sparkSession.createDataFrame(BACK_LINKS, "to string, as string, collection string, label string")
    return (links.join(F.broadcast(table), ["collection", "label"])
            .select(F.col("to").alias("collection"), "slug", F.col("as").alias("label"), "owner").distinct())


def build(raw: dict[str, DataFrame], documents: DataFrame | None = None, strict: bool = True) -> dict[str, DataFrame]:
    """Everything the published site is made from, as lazy frames by table name.

    ``documents`` holds ``(slug, title, kind, url, body)`` of the prose pages.
    """
    tables = typed_collections(raw)
    index = _index(tables)
    if "relationships" in tables:
        ends = resolve.resolve_endpoints(tables["relationships"], index.where("collection = 'people'"))
        if strict:
            lost = ends.where("`from` IS NULL OR `to` IS NULL").limit(20).collect()
            if lost:
                raise resolve.DanglingReference("; ".join(f"{r.slug}: {r['fromId']} → {r['toId']}" for r in lost))
        tables["relationships"] = ends.drop("fromId", "toId")
    links = cut_lineage(relation_links(tables, index, strict))
    if {"claim-records", "dispute-records"} <= set(tables):
        listed = links.where("collection = 'dispute-records' AND label = 'claims'").select(
            F.col("owner").alias("dispute"), F.col("slug").alias("claim"), F.col("pos").cast("bigint").alias("pos"))
        order = tables["claim-records"].select(F.col("slug").alias("claim"), F.col("ord").cast("bigint").alias("pos"))
        implied = (links.where("collection = 'claim-records' AND label = 'disputes'")
                   .select(F.col("slug").alias("dispute"), F.col("owner").alias("claim")).join(order, "claim"))
        tables["dispute-claims"] = cut_lineage(resolve.repair_reciprocal(listed, implied, "dispute", "claim"))
    tables["links"] = links
    tables["back-links"] = all_back_links(links)
    if "relationships" in tables:
        tables["relationship-links"] = resolve.edge_back_links(tables["relationships"])
    if {"people", "claim-records", "sources", "archives"} <= set(tables):
        nodes = graph.nodes(tables["people"], tables["claim-records"], tables["sources"], tables["archives"])
        edges = graph.claim_edges(links.where("collection = 'claim-records'"))
        if "relationships" in tables:
            edges = graph.person_edges(tables["relationships"]).unionByName(edges)
        groups = None
        if "dispute-claims" in tables:
            members = tables["dispute-claims"].select("dispute", "claim")
            groups = graph.contradictions(members)
            tables["graph-groups"] = groups
        tables["graph-nodes"], tables["graph-edges"] = graph.degree(nodes, edges, groups), edges
    if "events" in tables:
        tables["timeline"] = graph.timeline(tables["events"])
    spans = graph.uncertain_spans(next(iter(raw.values())).sparkSession)
    tables["uncertain"] = graph.span_disputes(spans, tables["dispute-records"]) if "dispute-records" in tables else spans
    tables["search-index"] = search.build_index(*[tables.get(n) for n in ("people", "events", "sources", "archives", "places", "groups")])
    if documents is not None:
        found = claim_ops.extract_claims(documents)
        people = tables.get("people")
        tables["claims"] = claim_ops.with_host(found, documents, people) if people is not None else found
        tables["claim-counts"] = claim_ops.status_counts(found)
    return tables
