"""Claims in prose, relations between records, and the graph."""

from functools import reduce

from pyspark.sql import functions as F

from probatum import fixed
from probatum.operators import claims as C
from probatum.operators import contain, graph, resolve
from probatum.operators.scale import list_pages, placed
from probatum.sources.documents import assemble
from workload import sqltext as S
from workload.records import quoted
from workload.registry import query

# ------------------------------------------------------------------ claims in prose
_LEADS = S.one_of([a for a, _, _ in fixed.LEAD_INS])
_CLAIM_RE = quoted(rf"(?i)^\*\*({_LEADS})\s*[.:]?\*\*\s*(.*)$")


def _plain(x):
    for pattern in ("`([^`]*)`", r"\*\*([^*]*)\*\*", r"\*([^*]*)\*", r"\[([^\]]*)\]\([^)]*\)"):
        x = f"regexp_replace({x}, {quoted(pattern)}, '\\1', 'g')"
    return S.squeeze(x)


PROSE_CLAIMS = f"""
    l AS (SELECT slug, unnest(regexp_split_to_array(body, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(body, '\\r?\\n'), 1) - 1 AS n FROM rec_bodies),
    f AS (SELECT *, coalesce(sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences FROM l),
    h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^#{{2,4}}\\s+(.*)$') THEN {_plain("regexp_extract(line, '^#{2,4}\\s+(.*)$', 1)")} END IGNORE NULLS)
            OVER (PARTITION BY slug ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM f WHERE fences % 2 = 0 AND line NOT LIKE '```%'),
    o AS (SELECT slug, n, section, {S.strip("regexp_replace(line, '^\\s*[-*]\\s+', '')")} AS opened FROM h WHERE NOT regexp_matches(line, '^#{{2,4}}\\s+')),
    m AS (SELECT *, lower(regexp_extract(opened, {_CLAIM_RE}, 1)) AS lead, {_plain(f"regexp_extract(opened, {_CLAIM_RE}, 2)")} AS text FROM o WHERE regexp_matches(opened, {_CLAIM_RE})),
    k(lead, canonical, status, flag) AS (VALUES {', '.join(f"({quoted(a.lower())}, {quoted(a)}, {quoted(b)}, {str(c).lower()})" for a, b, c in fixed.LEAD_INS)}),
    c AS (SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY n) - 1 AS i, section, canonical, status, text,
                 flag OR regexp_matches(text, '(?i)' || {quoted('|'.join(f'(?:{p})' for p in fixed.WITHHELD_PATTERNS))}) AS withheld
          FROM m JOIN k USING (lead) WHERE text <> '')"""


@query("prose_claims", f"""
    WITH {PROSE_CLAIMS}
    SELECT slug || '-' || i AS id, 'claim-' || i AS anchor, slug AS host, section, canonical AS lead_in, status, withheld,
           array_to_string(list_filter([{S.listed(fixed.TIERS)}], lambda t: contains(text, t)), ';') AS tiers,
           contains(text, 'NOT YET VERIFIED') AS unverified, text FROM c""", ("bodies",))
def prose_claims(t):
    found = C.extract_claims(t.bodies)
    return found.select("id", "anchor", F.col("hostSlug").alias("host"), "section", F.col("leadIn").alias("lead_in"), "status",
                        "withheld", F.array_join("tiers", ";").alias("tiers"), F.col("unverifiedRef").alias("unverified"), "text")


@query("paged_claims", f"""
    WITH long AS (SELECT 'in-' || coalesce(source, '') AS slug, string_agg(body, chr(10) ORDER BY ord) AS body FROM rec_bodies GROUP BY source),
    {PROSE_CLAIMS.replace("FROM rec_bodies", "FROM long")}
    SELECT slug || '-' || i AS id, section, canonical AS lead_in, status, withheld, text FROM c""", ("bodies",))
def paged_claims(t):
    """All bodies of a source as one long document, in pages that end anywhere."""
    lines = t.bodies.select(F.concat(F.lit("in-"), F.coalesce("source", F.lit(""))).alias("slug"), "ord", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    pages = assemble(lines, ["slug"], "ord", "line", glue="\n", page_size=97, ties=("pos",))
    return C.extract_paged_claims(pages).select("id", "section", F.col("leadIn").alias("lead_in"), "status", "withheld", "text")


@query("claims_with_hosts", f"""
    WITH {PROSE_CLAIMS}
    SELECT slug || '-' || i AS id, '/people/' || slug || '#claim-' || i AS url, p.name AS host, p.phase AS phase
    FROM c LEFT JOIN rec_people p USING (slug)""", ("bodies", "people"))
def claims_with_hosts(t):
    people = t.people.withColumn("phase", F.split("phase", "[|]"))
    hosts = people.select("slug", F.col("name").alias("title"), F.lit("person").alias("kind"), F.concat(F.lit("/people/"), "slug").alias("url"))
    return C.with_host(C.extract_claims(t.bodies), hosts, people).select("id", "url", "host", "phase")


def _hosted(t):
    people = t.people.withColumn("phase", F.split("phase", "[|]"))
    hosts = people.select("slug", F.col("name").alias("title"), F.lit("person").alias("kind"), F.concat(F.lit("/people/"), "slug").alias("url"))
    return C.with_host(C.extract_claims(t.bodies), hosts, people)


@query("claim_filter", f"""
    WITH {PROSE_CLAIMS},
    hosted AS (SELECT slug || '-' || i AS id, coalesce(status, 'Ungraded') AS status, withheld, p.phase AS phase, CASE WHEN p.slug IS NOT NULL THEN 'person' END AS kind FROM c LEFT JOIN rec_people p USING (slug))
    SELECT 'withheld' AS chosen, id FROM hosted WHERE withheld UNION ALL SELECT 'ungraded', id FROM hosted WHERE status = 'Ungraded'
    UNION ALL SELECT 'disputed in a phase', id FROM hosted WHERE status = 'Disputed' AND phase = 'IV 1912-1921' AND kind = 'person' UNION ALL SELECT 'all', id FROM hosted""", ("bodies", "people"))
def claim_filter(t):
    hosted = _hosted(t)
    chosen = {"withheld": dict(status=C.WITHHELD), "ungraded": dict(status=C.UNGRADED),
              "disputed in a phase": dict(status="Disputed", phase="IV 1912-1921", host="person"), "all": dict(status="")}
    parts = [C.filter_claims(hosted, **how).select(F.lit(name).alias("chosen"), "id") for name, how in chosen.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("claim_status_counts", f"""
    WITH {PROSE_CLAIMS}
    SELECT coalesce(status, 'Ungraded') AS status, count(*) AS n, count(*) FILTER (withheld) AS withheld FROM c GROUP BY 1""", ("bodies",))
def claim_status_counts(t):
    return C.status_counts(C.extract_claims(t.bodies))


@query("claim_counts_by_host", f"""
    WITH {PROSE_CLAIMS}
    SELECT slug AS host, coalesce(status, 'Ungraded') AS status, count(*) AS n, count(*) FILTER (withheld) AS withheld FROM c GROUP BY 1, 2""", ("bodies",))
def claim_counts_by_host(t):
    return C.status_counts(C.extract_claims(t.bodies), by_host=True).withColumnRenamed("hostSlug", "host")


# ------------------------------------------------------------------ relations
def _index(t):
    return resolve.id_index({"people": (t.people, "name"), "sources": (t.sources, "title"), "archives": (t.archives, "institution")})


def _claim_refs(t):
    """The relation lists of all claims, as ids."""
    ids = lambda kind, column: F.md5(F.concat(F.lit(kind), F.regexp_replace(column, "^[a-z]-", "")))
    labels = {"people": ("person", "person"), "primaryEvidence": ("source", "source"),
              "counterEvidenceSources": ("source", "counter_source"), "archives": ("archive", "archive")}
    return resolve.reference_lists(t.claims, {label: F.array(ids(k, c)) for label, (k, c) in labels.items()}, as_address=False)


_REFS = """
    refs AS (SELECT slug AS owner, 'people' AS label, person AS target FROM rec_claims UNION ALL
             SELECT slug, 'primaryEvidence', source FROM rec_claims UNION ALL
             SELECT slug, 'counterEvidenceSources', counter_source FROM rec_claims UNION ALL
             SELECT slug, 'archives', archive FROM rec_claims),
    known AS (SELECT slug, name FROM rec_people UNION ALL SELECT slug, title FROM rec_sources UNION ALL SELECT slug, institution FROM rec_archives)"""


@query("resolved_relations", f"""
    WITH {_REFS}
    SELECT owner, label, slug, name FROM refs JOIN known ON slug = target""", ("claims", "people", "sources", "archives"))
def resolved_relations(t):
    return resolve.links(resolve.resolve_references(_claim_refs(t), _index(t))).select("owner", "label", "slug", "name")


@query("dangling_relations", f"""
    WITH {_REFS}
    SELECT owner, label, md5('source' || substring(target, 3)) AS id FROM refs LEFT JOIN known ON slug = target WHERE slug IS NULL""",
       ("claims", "people", "sources", "archives"))
def dangling_relations(t):
    return resolve.dangling(resolve.resolve_references(_claim_refs(t), _index(t))).select("owner", "label", "id")


@query("resolved_endpoints", """
    SELECT r.slug, f.slug AS from_slug, f.name AS from_name, g.slug AS to_slug, g.name AS to_name FROM rec_relationships r
    LEFT JOIN rec_people f ON f.notionId = fromId LEFT JOIN rec_people g ON g.notionId = toId""", ("relationships", "people"))
def resolved_endpoints(t):
    edges = t.relationships.select("slug", "fromId", "toId")
    out = resolve.resolve_endpoints(edges, resolve.id_index({"people": (t.people, "name")}))
    return out.select("slug", F.col("from").alias("from_slug"), F.col("fromName").alias("from_name"),
                      F.col("to").alias("to_slug"), F.col("toName").alias("to_name"))


@query("lenient_event_people", """
    WITH e AS (SELECT slug, unnest(string_split(people, '|')) AS p FROM rec_incidents WHERE people <> '')
    SELECT e.slug AS event, p.slug AS person, p.name FROM e JOIN rec_people p ON p.slug = e.p""", ("incidents", "people"))
def lenient_event_people(t):
    refs = t.incidents.select(F.col("slug").alias("owner"), F.posexplode(F.split("people", "[|]")).alias("pos", "slug"))
    return resolve.pick(refs, t.people, ["name"]).select(F.col("owner").alias("event"), F.col("slug").alias("person"), "name")


@query("claim_back_links", """
    SELECT DISTINCT person AS slug, slug AS claim, 'people' AS side FROM rec_claims UNION ALL
    SELECT DISTINCT archive, slug, 'archives' FROM rec_claims""", ("claims",))
def claim_back_links(t):
    def side(column, label):
        links = t.claims.select(F.col("slug").alias("owner"), F.col(column).alias("slug"))
        return resolve.back_links(links).select("slug", F.col("owner").alias("claim"), F.lit(label).alias("side"))
    return side("person", "people").unionByName(side("archive", "archives"))


@query("relationship_back_links", """
    SELECT from_slug AS person, slug AS relationship FROM rec_relationships UNION
    SELECT to_slug, slug FROM rec_relationships WHERE to_slug IS NOT NULL""", ("relationships",))
def relationship_back_links(t):
    r = t.relationships.select("slug", F.col("from_slug").alias("from"), F.col("to_slug").alias("to"))
    return resolve.edge_back_links(r)


@query("back_link_pages", """
    WITH n AS (SELECT from_slug AS person, slug, row_number() OVER (PARTITION BY from_slug ORDER BY ord) - 1 AS i FROM rec_relationships)
    SELECT person, CAST(floor(i / 10) AS BIGINT) AS page, string_agg(slug, ';' ORDER BY i) AS relationships FROM n GROUP BY ALL""", ("relationships",))
def back_link_pages(t):
    r = t.relationships.select(F.col("from_slug").alias("person"), "slug", "ord")
    return list_pages(r, ["person"], "ord", "slug", page_size=10).select("person", "page", F.array_join("items", ";").alias("relationships"))


@query("reciprocal_claims", """
    WITH listed AS (SELECT DISTINCT dispute, slug AS claim FROM rec_claims WHERE pos <= 2),
         implied AS (SELECT DISTINCT dispute, slug AS claim FROM rec_claims)
    SELECT dispute, claim, CAST(CASE WHEN (dispute, claim) IN (SELECT (dispute, claim) FROM listed) THEN 0 ELSE 1 END AS INTEGER) AS added
    FROM implied""", ("claims",))
def reciprocal_claims(t):
    every = t.claims.select("dispute", F.col("slug").alias("claim"), "pos")
    return resolve.repair_reciprocal(every.where("pos <= 2"), every, "dispute", "claim").select("dispute", "claim", "added")


@query("related_records", """
    SELECT slug, institution FROM rec_archives WHERE slug IN (SELECT archive FROM rec_claims WHERE confidence = 'Established')""", ("claims", "archives"))
def related_records(t):
    links = t.claims.where("confidence = 'Established'").select(F.col("archive").alias("slug"))
    return resolve.related(t.archives, links).select("slug", "institution")


@query("attached_bodies", """
    SELECT c.c_custkey, md5(b.body) AS body FROM customer c LEFT JOIN rec_bodies b ON b.slug = 'p-' || c_custkey""", ("bodies",))
def attached_bodies(t):
    people = t.customer.select(F.concat(F.lit("p-"), F.col("c_custkey").cast("string")).alias("slug"), "c_custkey")
    return resolve.attach_body(people, t.bodies).select("c_custkey", F.md5("body").alias("body"))


@query("held_sources", """
    WITH a AS (SELECT slug AS archive, lower(trim(regexp_replace(institution, '\\s*\\(.*\\)\\s*$', ''))) AS short FROM rec_archives)
    SELECT archive, s.slug AS source FROM a JOIN rec_sources s ON contains(lower(coalesce(archivalReference, '')), short) OR contains(lower(coalesce(publisher, '')), short)""",
       ("archives", "sources"))
def held_sources(t):
    return contain.held_sources(t.archives, t.sources)


@query("settling_archives", """
    WITH w AS (SELECT slug AS dispute, unnest(list_filter(regexp_split_to_array(lower(currentAssessment), '[^a-zà-ÿ]+'), lambda x: length(x) > 5)) AS word
               FROM rec_disputes WHERE status = 'Settleable - request identified'),
         d AS (SELECT DISTINCT word FROM w),
         b AS (SELECT word, min(ord) AS ord FROM d JOIN rec_archives ON contains(lower(notYetSearched), word) GROUP BY word)
    SELECT dispute, 'a-' || min(ord) AS archive FROM w JOIN b USING (word) GROUP BY dispute""", ("disputes", "archives"))
def settling_archives(t):
    return contain.settling_archives(t.disputes, t.archives)


@query("uncovered_dossiers", """
    WITH p AS (SELECT slug, regexp_extract(name, '(\\S+)$', 1) AS surname FROM rec_people WHERE dossierStatus = 'Full dossier'),
         t AS (SELECT DISTINCT surname FROM p WHERE length(surname) >= 4),
         f AS (SELECT DISTINCT surname FROM t JOIN rec_sources s ON contains(concat_ws(' ', covers, biasNotes, title), surname))
    SELECT slug, surname FROM p WHERE length(surname) >= 4 AND surname NOT IN (SELECT surname FROM f)""", ("people", "sources"))
def uncovered_dossiers(t):
    return contain.uncovered_names(t.people.where("dossierStatus = 'Full dossier'"), t.sources).select("slug", "surname")


# ------------------------------------------------------------------ graph
def _nodes(t):
    people = t.people.withColumn("category", F.split("category", "[|]")).withColumn("phase", F.split("phase", "[|]"))
    claims = t.claims.dropDuplicates(["slug"])
    return graph.nodes(people, claims, t.sources, t.archives)


def _edges(t):
    links = resolve.links(resolve.resolve_references(_claim_refs(t), _index(t)))
    rel = t.relationships.select("slug", F.col("from_slug").alias("from"), F.col("to_slug").alias("to"), "relation", "evidenceStrength")
    return graph.person_edges(rel).unionByName(graph.claim_edges(links))


_GRAPH = f"""{_REFS},
    edges AS (
      SELECT 'person:' || from_slug AS source, 'person:' || to_slug AS target, 'person-person' AS kind, relation, evidenceStrength AS strength FROM rec_relationships
      UNION ALL SELECT CASE label WHEN 'people' THEN 'person:' || slug ELSE 'claim:' || owner END,
        CASE label WHEN 'people' THEN 'claim:' || owner WHEN 'archives' THEN 'archive:' || slug ELSE 'source:' || slug END,
        CASE label WHEN 'people' THEN 'person-claim' WHEN 'primaryEvidence' THEN 'claim-source' WHEN 'archives' THEN 'claim-archive' ELSE 'claim-counter-source' END,
        CASE label WHEN 'people' THEN 'is the subject of' WHEN 'primaryEvidence' THEN 'rests on' WHEN 'archives' THEN 'would be settled at' ELSE 'is contradicted by' END, NULL
      FROM refs JOIN known ON slug = target),
    nodes AS (SELECT 'person:' || slug AS id, 'person' AS kind, name AS label, phase FROM rec_people
      UNION ALL SELECT DISTINCT 'claim:' || slug, 'claim', first(claim), first(phase) FROM rec_claims GROUP BY slug
      UNION ALL SELECT 'source:' || slug, 'source', title, NULL FROM rec_sources
      UNION ALL SELECT 'archive:' || slug, 'archive', institution, NULL FROM rec_archives),
    degrees AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)"""
_GRAPH_RECORDS = ("claims", "people", "sources", "archives", "relationships")


@query("graph_nodes", f"""
    WITH {_GRAPH}
    SELECT id, kind, CASE kind WHEN 'claim' THEN NULL ELSE label END AS label FROM nodes""", _GRAPH_RECORDS)
def graph_nodes(t):
    return _nodes(t).select("id", "kind", F.when(F.col("kind") != "claim", F.col("label")).alias("label"))


@query("graph_edges", f"""
    WITH {_GRAPH}
    SELECT source, target, kind, relation, strength FROM edges""", _GRAPH_RECORDS)
def graph_edges(t):
    return _edges(t).select("source", "target", "kind", "relation", "strength")


@query("graph_degrees", f"""
    WITH {_GRAPH}
    SELECT nodes.id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees USING (id)""", _GRAPH_RECORDS)
def graph_degrees(t):
    return graph.degree(_nodes(t).select("id"), _edges(t))


@query("evidence_subgraph", f"""
    WITH {_GRAPH},
    live AS (SELECT id FROM nodes JOIN degrees USING (id) WHERE kind = 'person' AND phase = 'IV 1912-1921' AND degree > 0)
    SELECT source, target, strength FROM edges WHERE strength IN ('Documented', 'Well-attested in scholarship')
      AND source IN (SELECT id FROM live) AND target IN (SELECT id FROM live)""", _GRAPH_RECORDS)
def evidence_subgraph(t):
    edges = _edges(t)
    nodes = graph.degree(_nodes(t), edges)
    _, kept = graph.subgraph(nodes, edges, "Well-attested in scholarship", "IV 1912-1921")
    return kept.select("source", "target", "strength")


@query("claim_contradictions", """
    WITH m AS (SELECT DISTINCT dispute, slug FROM rec_claims)
    SELECT 'claim:' || slug AS source, 'dispute:' || dispute AS target, count(*) OVER (PARTITION BY dispute) AS members FROM m QUALIFY members > 1""", ("claims",))
def claim_contradictions(t):
    members = t.claims.select("dispute", F.col("slug").alias("claim")).distinct()
    return graph.contradictions(members).select("source", "target", "members")


@query("contradiction_degrees", """
    WITH m AS (SELECT DISTINCT archive, slug FROM rec_claims), n AS (SELECT archive, count(*) AS n FROM m GROUP BY archive)
    SELECT 'claim:' || slug AS id, CAST(sum(n - 1) AS BIGINT) AS degree FROM m JOIN n USING (archive) GROUP BY slug""", ("claims",))
def contradiction_degrees(t):
    """Groups of hundreds of claims: degrees without their pairs."""
    members = t.claims.select(F.col("archive").alias("dispute"), F.col("slug").alias("claim")).distinct()
    groups = graph.contradictions(members)
    nodes = members.select(F.concat(F.lit("claim:"), "claim").alias("id")).distinct()
    return graph.degree(nodes, groups.where("false").select("source", "target"), groups)


@query("event_timeline", """
    SELECT slug, start, row_number() OVER (ORDER BY coalesce(start, ''), slug) AS place FROM rec_incidents""", ("incidents",))
def event_timeline(t):
    return placed(t.incidents, graph.timeline_order()).select("slug", "start", "place")


@query("span_disputes", """
    SELECT s.slug, CAST(substring(start, 1, 4) AS INTEGER) AS "from", CAST(substring(start, 1, 4) AS INTEGER) + 3 AS "to", d.slug AS dispute, d.status AS status
    FROM rec_incidents s LEFT JOIN rec_disputes d ON d.ord = s.ord * 2 WHERE start IS NOT NULL""", ("incidents", "disputes"))
def span_disputes(t):
    year = F.substring("start", 1, 4).cast("int")
    spans = t.incidents.where("start IS NOT NULL").select(
        "slug", year.alias("from"), (year + 3).alias("to"), F.concat(F.lit("d-"), (F.col("ord") * 2).cast("string")).alias("dispute"))
    out = graph.span_disputes(spans, t.disputes)
    return out.select("slug", "from", "to", F.when(F.col("disputeTitle").isNotNull(), F.col("dispute")).alias("dispute"),
                      F.col("disputeStatus").alias("status"))
