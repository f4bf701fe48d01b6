"""Records derived from the test tables, in SQL that Spark and DuckDB both read.

``RECORDS`` maps a record table to the tables it reads and its query; ``{name}`` stands
for a table.  List fields are texts joined with ``|``.
"""

from __future__ import annotations

from probatum import fixed


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def pick(index: str, values) -> str:
    """A value by a row number, in turn."""
    values = list(values)
    arms = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values))
    return f"(CASE CAST({index} AS BIGINT) % {len(values)} {arms} END)"


def over(index: str, n: int) -> str:
    return f"floor({index} / {n})"


def letters(index: str) -> str:
    """A made-up word for a number."""
    return f"translate(CAST(CAST({index} AS BIGINT) AS STRING), '0123456789', 'abdefghlmn')"


GIVEN = ["Mohamed", "Mohammed", "Moha", "Mouha", "Muḥa", "Ahmed", "Hammou", "Ḥemmu", "Abd el-Krim"]
MIDDLE = ["ou", "ben", "Sellam", "ou Said", "Ben Hammou"]
FAMILY = ["Zayani", "Zaïani", "Aẓayyi", "Ameziane", "El Khattabi", "Khattabi", "Raisuni", "Raïssouni", "Tazi",
          "Glaoui", "El Glaoui", "Hiba", "Oufkir"]

# A body with headings, fences and graded claims before the document's own text.
_NL = "chr(10)"
_BODIES = [
    "'## Record' || nl || '**Established:** The dahir was issued; see PRIMARY_ARCHIVAL holdings.' || nl",
    "'## Origins' || nl || '- **Highly probable.** He was born in the *Middle* Atlas.' || nl || '```' || nl || '**Disputed:** inside a fence' || nl || '## Not a heading' || nl || '```' || nl",
    "'### Dates' || nl || '**Disputed:** The Spanish lost 13,363 men at Annual in 1921.' || nl || '**Withheld:** The file remains classified.' || nl",
    "'**Contested:** Sources [differ](http://x) on the day. ARCHIVAL REFERENCE NOT YET VERIFIED' || nl || '## Later' || nl || '**Status:** open' || nl || '**Unknown:**' || nl",
    "'> **Terminology warning.** The word dissident is quoted.' || nl || 'A dissident chief; a bandit (bandit) and \"rogui\" of the Atlas.' || nl || 'French reports called him a rebelle.' || nl",
    "'**Reliable on:** dates, per ACADEMIC and SECONDARY work' || nl || '## Losses' || nl || 'At Casablanca in 1907 the dead were 600.' || nl || 'At Casablanca in 1907 they were 600 to 1,500.' || nl",
    "''",
]

RECORDS: dict[str, tuple[tuple[str, ...], str]] = {}

RECORDS["bodies"] = (("documents",), f"""
    SELECT doc_id AS ord, 'p-' || CAST(doc_id AS STRING) AS slug, lang, source,
           (CASE doc_id % {len(_BODIES)} """ + " ".join(
    f"WHEN {i} THEN {b.replace('nl', _NL)}" for i, b in enumerate(_BODIES)) + """ END) || text AS body
    FROM {documents}""")

RECORDS["people"] = (("customer",), f"""
    SELECT c_custkey AS ord, 'p-' || CAST(c_custkey AS STRING) AS slug,
           md5('person' || CAST(c_custkey AS STRING)) AS notionId,
           {pick('c_custkey', GIVEN)} || ' ' || {pick(over('c_custkey', 9), MIDDLE)} || ' ' ||
             {pick(over('c_custkey', 45), FAMILY)} ||
             (CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' ' || {letters(over('c_custkey', 7))} END) AS name,
           (CASE c_custkey % 4
              WHEN 0 THEN 'Fr. archives: ''Moha ou Hammou'', ''le caïd ' || c_name || ''', des Zaïanes · Tamazight: Muḥa'
              WHEN 1 THEN 'Mohammed Sellam Ameziane · ' || c_name
              WHEN 2 THEN 'Name as supplied here by one. Do not merge ' || c_name ELSE 'Ar.: محا أو حمو ' || c_name END) AS aliasesRaw,
           (CASE c_custkey % 5 WHEN 0 THEN '18' || CAST(36 + c_custkey % 60 AS STRING) || ' (conventional). Some give 1857'
              WHEN 1 THEN '1836-01-01' WHEN 2 THEN 'not established' WHEN 3 THEN ' ' ELSE 'c. 19' || CAST(10 + c_custkey % 80 AS STRING) END) AS born,
           (CASE c_custkey % 3 WHEN 0 THEN '1921' WHEN 1 THEN NULL ELSE '1934-05-26T00:00' END) AS died,
           {pick('c_custkey', fixed.CATEGORIES + ['Poet'])} || (CASE WHEN c_custkey % 2 = 0 THEN '|' || {pick('c_custkey + 5', fixed.CATEGORIES)} ELSE '' END) AS category,
           {pick('c_nationkey', fixed.REGIONS)} AS region,
           {pick('c_custkey', fixed.PHASES)} AS phase,
           (CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Full dossier' WHEN 'BUILDING' THEN 'Substantial'
              WHEN 'FURNITURE' THEN 'Stub' WHEN 'HOUSEHOLD' THEN 'Identified - not yet researched' ELSE 'Almost done' END) AS dossierStatus,
           (CASE WHEN c_acctbal > 8000 THEN 'Strong - archival + academic' WHEN c_acctbal > 4000 THEN 'Moderate - academic'
              WHEN c_acctbal > 0 THEN 'Thin - encyclopedic leads only' WHEN c_acctbal > -500 THEN 'Contested' ELSE NULL END) AS evidenceBase,
           {pick('c_custkey', fixed.IMPACT + [None])} AS impact,
           (CASE c_custkey % 5 WHEN 0 THEN 'I judge him decisive.' WHEN 1 THEN 'Decisive; a signed order would change this.'
              WHEN 2 THEN 'Minor, unless letters turn up.' ELSE NULL END) AS assessment,
           (CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE '2026-0' || CAST(1 + c_custkey % 8 AS STRING) || '-1' || CAST(c_custkey % 10 AS STRING) END) AS lastReviewed,
           (CASE c_custkey % 4 WHEN 0 THEN 'I think he led ' || CAST(c_custkey AS STRING) || ' to ' || CAST(c_custkey + 300 AS STRING) || ' men.'
              WHEN 1 THEN 'A rebelle of the Rif.' WHEN 2 THEN 'Estimated at about 8,000 dead in 1958.' ELSE NULL END) AS oneLine,
           (CASE WHEN c_custkey % 3 = 0 THEN 'The date of his investiture.' ELSE NULL END) AS contestedPoints
    FROM {{customer}}""")

RECORDS["dossiers"] = (("people", "bodies"), """
    SELECT /*+ MERGE(b) */ p.*, b.body || (CASE WHEN p.ord % 50 = 0 THEN chr(10) || 'See small ring reports on the ring. NOT YET VERIFIED' ELSE '' END) AS body
    FROM {people} p LEFT JOIN {bodies} b ON b.ord = p.ord""")

RECORDS["sources"] = (("part",), f"""
    SELECT p_partkey AS ord, 's-' || CAST(p_partkey AS STRING) AS slug,
           md5('source' || CAST(p_partkey AS STRING)) AS notionId,
           p_name || ' reports on the ' || p_type || ' campaigns, ' || p_brand AS title,
           (CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END) AS author,
           'Service of ' || {pick('p_partkey', ['France', 'Spain', 'Rabat', 'the Archive of NATION_7'])} AS publisher,
           {pick('p_size', fixed.SOURCE_LANGUAGES + ['Latin'])} AS language,
           {pick('p_size', fixed.TIERS + ['RUMOUR'])} AS tier,
           (CASE WHEN p_partkey % 2 = 0 THEN 'https://x/' || CAST(p_partkey AS STRING) ELSE NULL END) AS sourceUrl,
           (CASE p_partkey % 6 WHEN 0 THEN 'SHD 3H 1247. NOT YET VERIFIED.' WHEN 1 THEN 'n/a'
              WHEN 2 THEN 'SHD, sous-série GR 3H, 3H 314–752, c. 3,000 articles. NOT YET VERIFIED.'
              WHEN 3 THEN 'BOA HR.SYS. 2392/2' WHEN 4 THEN 'AGA, caja 81, Archive of NATION_' || CAST(p_partkey % 25 AS STRING) ELSE NULL END) AS archivalReference,
           {pick('p_partkey', fixed.SOURCE_VERIFICATION + ['NOT YET VERIFIED', None, 'Seen'])} AS verification,
           (CASE WHEN p_partkey % 5 = 0 THEN 'In my view partisan.' ELSE 'Official view' END) AS biasNotes,
           'Covers ' || {pick('p_partkey', FAMILY[:9])} || ' and ' || {letters(over('p_partkey', 11))} AS covers
    FROM {{part}}""")

RECORDS["archives"] = (("supplier", "nation"), f"""
    SELECT s_suppkey AS ord, 'a-' || CAST(s_suppkey AS STRING) AS slug,
           md5('archive' || CAST(s_suppkey AS STRING)) AS notionId,
           'Archive of ' || n_name || ' (' || s_name || ')' AS institution,
           {pick('s_suppkey', fixed.COUNTRIES + ['Atlantis'])} AS country,
           (CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'City ' || CAST(s_nationkey AS STRING) END) AS city,
           (CASE s_suppkey % 3 WHEN 0 THEN 'Série X' WHEN 1 THEN 'Fonds 12, dossier 44' ELSE 'MB 12/4 NOT YET VERIFIED' END) AS fonds,
           (CASE WHEN s_suppkey % 6 = 0 THEN 'My reading: rich.' ELSE 'Registers' END) AS holdings,
           {pick('s_suppkey', fixed.DIGITISED + [None])} AS digitised,
           {pick('s_suppkey', fixed.ARCHIVE_VERIFICATION + [None])} AS verification,
           {pick('s_nationkey', fixed.PRIORITY)} AS priority,
           (CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Letters of ' || {pick('s_suppkey', ['the garrison', 'the treaty commission', 'Marshal ' + GIVEN[0]])}
              || ' and registers of ' || {letters('s_suppkey')} END) AS notYetSearched
    FROM {{supplier}} JOIN {{nation}} ON n_nationkey = s_nationkey""")

RECORDS["incidents"] = (("events",), f"""
    SELECT event_id AS ord, 'e-' || CAST(event_id AS STRING) AS slug,
           md5('event' || CAST(event_id AS STRING)) AS notionId,
           event_type || ' of ' || {pick('event_id', fixed.REGIONS)} AS event,
           (CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS STRING) END) AS start,
           {pick('event_id', fixed.REGIONS)} AS location, {pick('user_id', fixed.PHASES + ['XI'])} AS phase,
           {pick('event_id', fixed.EVENT_TYPES)} AS type,
           {pick('user_id', fixed.DOSSIER_STATUS)} AS dossierStatus,
           'At Annual in 1921 the losses were ' || {pick('event_id', ['13,363', '7,875 to 13,363', '8180', 'put at 8,668'])} || ' men. Value ' || CAST(event_id AS STRING) AS summary,
           (CASE WHEN event_id % 4 = 0 THEN 'Who began it' ELSE NULL END) AS mainDispute,
           (CASE WHEN event_id % 5 = 0 THEN '' ELSE 'p-' || CAST(user_id AS STRING) || '|p-' || CAST(user_id + event_id % 7 AS STRING) END) AS people,
           CAST(NULL AS STRING) AS body
    FROM {{events}}""")

RECORDS["relationships"] = (("orders",), f"""
    SELECT o_orderkey AS ord, 'r-' || CAST(o_orderkey AS STRING) AS slug,
           'Relation ' || CAST(o_orderkey % 50 AS STRING) AS label,
           md5('person' || CAST(o_custkey AS STRING)) AS fromId,
           md5('person' || CAST(CASE WHEN o_orderkey % 29 = 0 THEN o_custkey WHEN o_orderkey % 31 = 0 THEN -1 ELSE o_custkey + 1 END AS STRING)) AS toId,
           'p-' || CAST(o_custkey AS STRING) AS from_slug,
           (CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'p-' || CAST(o_custkey AS STRING) ELSE 'p-' || CAST(o_custkey + 1 AS STRING) END) AS to_slug,
           {pick('o_orderkey', fixed.RELATION_VERBS + ['cousin of'])} AS relation,
           (CASE o_orderpriority WHEN '1-URGENT' THEN 'Documented' WHEN '2-HIGH' THEN 'Well-attested in scholarship'
              WHEN '3-MEDIUM' THEN 'Single source assertion' WHEN '5-LOW' THEN 'Traditional / oral' ELSE 'Disputed' END) AS evidenceStrength,
           (CASE WHEN o_orderkey % 40 = 0 THEN 'It seems to me certain.' ELSE 'A letter' END) AS evidence
    FROM {{orders}}""")

# One claim per order line: its subject is the customer, its evidence the part, its
# archive the supplier, and it belongs to the dispute of its order.
RECORDS["claims"] = (("lineitem", "orders"), f"""
    SELECT 'c-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS slug,
           l_orderkey AS dispute_no, l_linenumber AS pos,
           'p-' || CAST(o_custkey AS STRING) AS person, 's-' || CAST(l_partkey AS STRING) AS source,
           's-' || CAST(l_partkey + l_linenumber * 300 AS STRING) AS counter_source,
           'a-' || CAST(l_suppkey AS STRING) AS archive, 'd-' || CAST(l_orderkey AS STRING) AS dispute,
           'Claim of ' || l_returnflag || l_linestatus AS claim,
           {pick('l_partkey', fixed.CLAIM_STATUSES + [None])} AS confidence,
           {pick('l_suppkey', fixed.PHASES + [None])} AS phase,
           (CASE l_partkey % 4 WHEN 0 THEN 'Not yet consulted directly' WHEN 1 THEN ' ' WHEN 2 THEN 'not applicable here' ELSE 'The letter says so' END) AS whatTheDocumentSays,
           (CASE l_partkey % 3 WHEN 0 THEN 'ARCHIVAL REFERENCE NOT YET VERIFIED. Request carton 12' WHEN 1 THEN NULL ELSE 'SHD 3H' END) AS archivalReference
    FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey""")

RECORDS["disputes"] = (("orders",), f"""
    SELECT o_orderkey AS ord, 'd-' || CAST(o_orderkey AS STRING) AS slug, 'Dispute ' || CAST(o_orderkey AS STRING) AS dispute,
           (CASE WHEN o_orderkey % 2 = 0 THEN 'Acted first' ELSE NULL END) AS french,
           (CASE WHEN o_orderkey % 3 = 0 THEN 'Was provoked' ELSE NULL END) AS spanish,
           (CASE WHEN o_orderkey % 5 = 0 THEN 'Resisted' ELSE NULL END) AS moroccan,
           (CASE WHEN o_orderkey % 7 = 0 THEN 'Observed' ELSE NULL END) AS other,
           (CASE o_orderstatus WHEN 'F' THEN 'Resolved' WHEN 'O' THEN 'Settleable - request identified' ELSE NULL END) AS status,
           {pick('o_orderkey', fixed.PHASES)} AS phase,
           'Would be settled by the ' || {pick('o_custkey', ['garrison lists', 'treaty drafts', 'commission minutes', 'notes'])} AS currentAssessment
    FROM {{orders}}""")

# Two dated states of the same people: the later one misses some and gains others, and
# some fields have moved.
RECORDS["people_before"] = (("dossiers",), "SELECT * FROM {dossiers} WHERE ord % 17 <> 0")
RECORDS["people_after"] = (("dossiers",), """
    SELECT ord, slug, notionId, name, aliasesRaw, born, died, category, region, phase, dossierStatus,
           (CASE WHEN ord % 7 = 0 AND evidenceBase = 'Thin - encyclopedic leads only' THEN 'Moderate - academic' ELSE evidenceBase END) AS evidenceBase,
           impact, (CASE ord % 10 WHEN 0 THEN NULL WHEN 1 THEN assessment || ' Revised.' ELSE assessment END) AS assessment,
           lastReviewed,
           (CASE WHEN ord % 4 = 0 AND ord % 8 = 0 THEN 'He led ' || CAST(ord + 300 AS STRING) || ' men.'
                 WHEN ord % 4 = 2 AND ord % 3 = 0 THEN 'There were 8,000 dead in 1958.' ELSE oneLine END) AS oneLine,
           (CASE WHEN ord % 9 = 0 THEN NULL ELSE contestedPoints END) AS contestedPoints, body
    FROM {dossiers} WHERE ord % 13 <> 0""")
RECORDS["sources_before"] = (("sources",), "SELECT * FROM {sources} WHERE ord % 97 <> 0")
RECORDS["sources_after"] = (("sources",), """
    SELECT ord, slug, notionId, title, author, publisher, language,
           (CASE WHEN ord % 11 = 0 AND tier = 'SECONDARY' THEN 'ACADEMIC' ELSE tier END) AS tier, sourceUrl,
           (CASE WHEN ord % 12 = 1 THEN 'SHD 3H 9' ELSE archivalReference END) AS archivalReference,
           (CASE WHEN ord % 5 = 0 AND verification = 'NOT YET VERIFIED' THEN 'Catalogue verified' ELSE verification END) AS verification,
           biasNotes, covers
    FROM {sources}""")


def with_records(sql: str, uses: tuple[str, ...]) -> str:
    """The SQL with the record tables it needs as common table expressions."""
    order: list[str] = []

    def visit(name):
        if name in RECORDS and name not in order:
            for needed in RECORDS[name][0]:
                visit(needed)
            order.append(name)

    for name in uses:
        visit(name)
    if not order:
        return sql.strip()
    parts = []
    for name in order:
        needs, text = RECORDS[name]
        # records shadow a base table of the same name only by their own label
        parts.append(f"{label(name)} AS (" + text.strip().format(**{n: label(n) if n in RECORDS else n for n in needs}) + ")")
    body = sql.strip()
    glue = ", " if body.upper().startswith("WITH ") else " "
    return "WITH " + ", ".join(parts) + glue + (body[5:] if glue == ", " else body)


def label(name: str) -> str:
    return f"rec_{name}"
