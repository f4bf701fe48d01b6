"""Data-quality rules over the derived records."""

from datetime import date

from pyspark.sql import functions as F

from probatum import fixed
from probatum.config import Settings
from probatum.functions.names import split_aliases
from probatum.operators import claims as C
from probatum.operators import rules as R
from probatum.operators import tallies
from workload import sqltext as S
from workload.records import quoted
from workload.registry import query

SETTINGS = Settings(as_of=date(2026, 8, 16))
_SHOWN = ["severity", "collection", "slug", "field", "message"]


class Snapshot:
    """The record tables under their collection names, lists split."""

    def __init__(self, t, people="people", sources="sources"):
        split = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "[|]"))
        self._of = {
            "people": lambda: t[people].withColumn("category", split("category")).withColumn("region", split("region"))
            .withColumn("phase", split("phase")).withColumn("aliases", split_aliases(F.col("aliasesRaw"))),
            "events": lambda: t.incidents.withColumn("type", split("type")).withColumn("people", split("people")),
            "sources": lambda: t[sources].withColumn("language", split("language")),
            "archives": lambda: t.archives,
            "relationships": lambda: t.relationships.withColumnRenamed("from_slug", "from").withColumnRenamed("to_slug", "to")
            .withColumn("fromName", F.col("from")).withColumn("toName", F.col("to")),
        }

        self._built = {}

    def get(self, name):
        if name in self._of and name not in self._built:
            self._built[name] = self._of[name]()
        return self._built.get(name)

    def __getitem__(self, name):
        return self.get(name)


def shown(findings):
    return findings.select(*_SHOWN)


# ------------------------------------------------------------------ R01 and the first report
def _vocabulary_sql(checks, tables):
    parts = []
    for collection, name, allowed, multi, nullable in checks:
        if collection not in tables:
            continue
        table, is_list = tables[collection], multi
        value = f"unnest(string_split({name}, '|'))" if is_list else name
        parts.append(f"""SELECT '{collection}' AS collection, slug, '{name}' AS field, v FROM (SELECT slug, {value} AS v FROM {table})
            WHERE (v IS NULL AND {str(not (nullable or multi)).lower()}) OR (v IS NOT NULL AND v NOT IN ({S.listed(allowed)}))""")
    return " UNION ALL ".join(parts)


_TABLES = {"people": "rec_people", "events": "rec_incidents", "sources": "rec_sources", "archives": "rec_archives",
           "relationships": "rec_relationships"}
_ALL = ("people", "incidents", "sources", "archives", "relationships")
_BAD_MESSAGE = """CASE WHEN v IS NULL THEN field || ' has no value' ELSE field || ' = "' || v || '" is outside the vocabulary' END"""


@query("vocabulary_report", f"""
    WITH bad AS ({_vocabulary_sql(fixed.VOCABULARY_CHECKS, _TABLES)}),
         v(value, i) AS (VALUES {', '.join(f"({quoted(v)}, {i})" for i, v in enumerate(fixed.DOSSIER_STATUS))}),
         t AS (SELECT coalesce(dossierStatus, '(not recorded)') AS value, count(*) AS n FROM rec_people GROUP BY 1)
    SELECT 'finding' AS kind, collection || '.' || field AS name, coalesce(v, '(empty)') AS value, count(*) AS n FROM bad GROUP BY ALL
    UNION ALL SELECT 'tally', 'dossierStatus', coalesce(v.value, t.value), coalesce(n, 0) FROM v FULL JOIN t ON v.value = t.value""", _ALL)
def vocabulary_report(t):
    """Vocabulary findings by value, and the zero-filled tally of dossier status."""
    snapshot = Snapshot(t)
    bad = R.vocabulary_values(snapshot)
    found = bad.groupBy(F.concat_ws(".", "collection", "field").alias("name"), F.coalesce("value", F.lit("(empty)")).alias("value")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("finding").alias("kind"), "name", "value", "n")
    tally = tallies.tallies(t.people, {"dossierStatus": ("dossierStatus", fixed.DOSSIER_STATUS)})
    return found.unionByName(tally.select(F.lit("tally").alias("kind"), F.col("dimension").alias("name"), "value", "n"))


@query("rule_vocabulary", f"""
    WITH bad AS ({_vocabulary_sql(fixed.VOCABULARY_CHECKS, _TABLES)})
    SELECT 'error' AS severity, collection, slug, field, {_BAD_MESSAGE} AS message FROM bad""", _ALL)
def rule_vocabulary(t):
    return shown(R.r01(Snapshot(t), SETTINGS))


@query("rule_orders_vocabulary", """
    SELECT 'orders' AS collection, CAST(o_orderkey AS STRING) AS slug, 'o_orderpriority' AS field, o_orderpriority AS value FROM orders
    WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
    UNION ALL SELECT 'customer', CAST(c_custkey AS STRING), 'c_mktsegment', c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')""")
def rule_orders_vocabulary(t):
    checks = [("orders", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], False, False),
              ("customer", "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"], False, False)]
    frames = {"orders": t.orders.withColumn("slug", F.col("o_orderkey")), "customer": t.customer.withColumn("slug", F.col("c_custkey"))}
    return R.vocabulary_values(frames, checks).drop("allowed")


# ------------------------------------------------------------------ R02
_ITEM = [f.replace("(?i)", "") for f, _ in fixed.ITEM_LEVEL]


@query("rule_references", f"""
    WITH found AS (SELECT 'sources' AS collection, slug, title, archivalReference AS ref FROM rec_sources WHERE verification = 'NOT YET VERIFIED'
                   UNION ALL SELECT 'archives', slug, institution, fonds FROM rec_archives WHERE verification = 'NOT YET VERIFIED'),
         m AS (SELECT * FROM found WHERE ref IS NULL OR NOT contains(ref, 'NOT YET VERIFIED')),
         heads AS (SELECT DISTINCT substring(title, 1, 24) AS head FROM m),
         named AS (SELECT DISTINCT head FROM heads JOIN rec_dossiers p ON contains(p.body, head)),
         hits AS (
           SELECT collection, slug, ref, unnest(regexp_extract_all(ref, '\\b(\\d?[A-Z]{{1,3}}\\s?\\d{{2,5}})\\b(\\s*[–—-]\\s*\\d)?', 1)) AS hit,
                  unnest(regexp_extract_all(ref, '\\b(\\d?[A-Z]{{1,3}}\\s?\\d{{2,5}})\\b(\\s*[–—-]\\s*\\d)?', 2)) AS tail FROM found
           UNION ALL SELECT collection, slug, ref, unnest(regexp_extract_all(ref, '\\b[A-Z]{{2,3}}(?:\\.[A-Z]{{2,4}})*\\.?\\s?\\d{{2,5}}[/-]\\d{{1,3}}\\b')), '' FROM found
           UNION ALL SELECT collection, slug, ref, unnest(regexp_extract_all(ref, {quoted(fixed.ITEM_LEVEL[2][0])})), '' FROM found)
    SELECT 'error' AS severity, collection, slug, 'archivalReference' AS field, 'Unverified, and no text says so' AS message
    FROM m WHERE substring(title, 1, 24) NOT IN (SELECT head FROM named) OR NOT EXISTS (SELECT 1 FROM rec_dossiers WHERE contains(body, 'NOT YET VERIFIED'))
    UNION ALL SELECT 'error', collection, slug, 'archivalReference', 'Single item cited: "' || hit || '" although the record is NOT YET VERIFIED'
    FROM hits WHERE coalesce(tail, '') = '' AND NOT regexp_matches(ref, '(?i)' || {quoted(fixed.SERIES_LEVEL)})""", ("dossiers", "sources", "archives"))
def rule_references(t):
    return shown(R.r02(Snapshot(t, "dossiers"), SETTINGS))


# ------------------------------------------------------------------ R03
_FORMS = [(q[1], v, form, [c.lower() for c in q[5]], [f for x in q[2] if x != v for f in ([f"{x:,}", str(x)] if x >= 1000 else [str(x)])])
          for q in fixed.QUANTITIES for v in q[2] for form in ([f"{v:,}", str(v)] if v >= 1000 else [str(v)])]
_LIST = lambda xs: "[" + ", ".join(quoted(x) for x in xs) + "]"
_TEXTS = """
    t AS (SELECT 'people' AS collection, slug, 'oneLine' AS field, oneLine AS text FROM rec_dossiers
          UNION ALL SELECT 'people', slug, 'contestedPoints', contestedPoints FROM rec_dossiers UNION ALL SELECT 'people', slug, 'body', body FROM rec_dossiers
          UNION ALL SELECT 'events', slug, 'summary', summary FROM rec_incidents UNION ALL SELECT 'events', slug, 'mainDispute', mainDispute FROM rec_incidents
          UNION ALL SELECT 'sources', slug, 'covers', covers FROM rec_sources UNION ALL SELECT 'sources', slug, 'biasNotes', biasNotes FROM rec_sources)"""
_ALONE = lambda text, form: (f"regexp_matches({text}, '(^|[^0-9.,])' || {form} || '($|[^0-9.,]|[.,]$|[.,][^0-9])')")


@query("rule_bare_figures", f"""
    WITH {_TEXTS},
    q(label, value, form, context, siblings) AS (VALUES {', '.join(f"({quoted(a)}, {b}, {quoted(c)}, {_LIST(d)}, {_LIST(e)})" for a, b, c, d, e in _FORMS)}),
    p AS (SELECT *, string_split(text, form) AS parts FROM t JOIN q ON contains(text, form)),
    o AS (SELECT *, unnest(range(1, len(parts))) AS i FROM p),
    s AS (SELECT *, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length(form) AS start FROM o),
    v AS (SELECT *, substring(text, start, 1) AS prev, substring(text, start + length(form) + 1, 1) AS n1, substring(text, start + length(form) + 2, 1) AS n2,
                 substring(text, 1, start) AS lef, substring(text, start + 1) AS rig FROM s),
    w AS (SELECT *, list_sort(list_transform(['. ', chr(10), '; ', '| '], lambda d: {{'n': length(string_split(lef, d)[-1]), 's': string_split(lef, d)[-1]}}))[1].s ||
                 list_sort(list_transform(['. ', chr(10), ' |'], lambda d: {{'n': length(string_split(rig, d)[1]), 's': string_split(rig, d)[1]}}))[1].s AS sentence,
                 lower(substring(text, greatest(start - 600, 0) + 1, start + 600 - greatest(start - 600, 0))) AS topic
          FROM v WHERE (start = 0 OR NOT regexp_matches(prev, '[0-9.,]')) AND NOT regexp_matches(n1, '[0-9]') AND NOT (regexp_matches(n1, '[.,]') AND regexp_matches(n2, '[0-9]')))
    SELECT 'error' AS severity, collection, slug, field, 'Figure without its range: ' || form || ' stands alone for ' || label AS message FROM w
    WHERE len(list_filter(context, lambda c: contains(topic, c))) > 0
      AND len(list_filter(regexp_extract_all(sentence, '(?:^|[^0-9.,])([0-9][0-9,]*\\s*(?:[–—-]|to|and)\\s*[0-9][0-9,]*)(?:[^0-9.,]|$)', 1), lambda r: contains(r, form))) = 0
      AND len(list_filter(siblings, lambda x: {_ALONE('sentence', 'x')})) = 0
      AND NOT regexp_matches(sentence, '(?i)' || {quoted(fixed.QUALIFIED)})""", ("dossiers", "incidents", "sources"))
def rule_bare_figures(t):
    return shown(R.r03(Snapshot(t, "dossiers"), SETTINGS))


# ------------------------------------------------------------------ R04 and its publishing variant
def _term_hits(terms, lines):
    return f"""
    k(term) AS (VALUES {', '.join(f'({quoted(x)})' for x in terms)}),
    p AS (SELECT l.*, term, string_split(lower(line), lower(term)) AS parts FROM {lines} l JOIN k ON contains(lower(line), lower(term))),
    o AS (SELECT *, unnest(range(1, len(parts))) AS i FROM p),
    s AS (SELECT *, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length(term) AS start FROM o),
    v AS (SELECT *, substring(line, start + 1, length(term)) AS hit, substring(line, 1, start) AS ahead FROM s
          WHERE (start = 0 OR NOT regexp_matches(substring(line, start, 1), '[A-Za-z0-9_]')) AND NOT regexp_matches(substring(line, start + length(term) + 1, 1), '[A-Za-z0-9_]')),
    z AS (SELECT *, rtrim(right(ahead, 3)) AS b3, ltrim(substring(line, start + length(term) + 1, 3)) AS a3, rtrim(right(ahead, 40)) AS b40,
                 ltrim(substring(line, start + length(term) + 1, 40)) AS a40, length(regexp_replace(ahead, '[^"“”«»]', '', 'g')) AS quotes,
                 length(regexp_replace(ahead, '[^`]', '', 'g')) AS ticks FROM v)"""


_UNMARKED = """NOT ((regexp_matches(b3, '["“”''‘’«»]$') AND regexp_matches(a3, '^["“”''‘’«»]')) OR (regexp_matches(b3, '[*_`]$') AND regexp_matches(a3, '^[*_`]'))
      OR regexp_matches(b3, '\\($') OR quotes % 2 = 1 OR ticks % 2 = 1)"""


@query("rule_terms", f"""
    WITH t AS (SELECT 'people' AS collection, slug, 'oneLine' AS field, oneLine AS text FROM rec_dossiers UNION ALL SELECT 'people', slug, 'body', body FROM rec_dossiers
               UNION ALL SELECT 'events', slug, 'summary', summary FROM rec_incidents),
    l0 AS (SELECT collection, slug, field, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line FROM t),
    l AS (SELECT * FROM l0 WHERE NOT regexp_matches(line, '^\\s*>') AND NOT regexp_matches(line, '(?i)' || {quoted(fixed.EXPLANATORY)})
            AND NOT regexp_matches(line, '(?i)' || {quoted(fixed.ATTRIBUTED)})),
    {_term_hits(fixed.TERM_WATCHLIST, 'l')}
    SELECT 'warn' AS severity, collection, slug, field, 'Watched term not set apart: "' || hit || '"' AS message FROM z WHERE {_UNMARKED}""", ("dossiers", "incidents"))
def rule_terms(t):
    return shown(R.r04(Snapshot(t, "dossiers"), SETTINGS))


@query("publish_terms", f"""
    WITH l0 AS (SELECT slug, unnest(regexp_split_to_array(body, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(body, '\\r?\\n'), 1) AS n FROM rec_bodies),
    l AS (SELECT * FROM l0 WHERE NOT regexp_matches(line, '^\\s*>') AND NOT contains(line, '<ColonialTerm')),
    {_term_hits([x for x, _, _ in fixed.TERM_DICTIONARY], 'l')}
    SELECT 'warn' AS severity, 'documents' AS collection, slug, NULL AS field, slug || ':' || n || ': "' || hit || '" is not set apart' AS message FROM z
    WHERE NOT (regexp_matches(b40, '["“''‘*`]$') OR regexp_matches(a40, '^["”''’*`]') OR ticks % 2 = 1)""", ("bodies",))
def publish_terms(t):
    return shown(R.published_terms(t.bodies))


# ------------------------------------------------------------------ R05
def _key(x):
    return f"array_to_string({S.fold_tokens(x, S.match_fold(x))}, ' ')"


_PAIRS = f"""d(a, b, why) AS (VALUES {', '.join(f"({quoted(a)}, {quoted(b)}, 1)" for a, b in fixed.KNOWN_DISTINCT)}),
    pairs AS (SELECT a, b, {_key('a')} AS a_key, {_key('b')} AS b_key FROM d),
    p0 AS (SELECT slug, name, ord, {S.match_fold('name')} AS f FROM rec_people), p AS (SELECT slug, name, ord, array_to_string({S.fold_tokens('name', 'f')}, ' ') AS key FROM p0),
    own AS (SELECT key, max_by(struct_pack(slug := slug, name := name), ord) AS o FROM p GROUP BY key)"""


@query("name_conflations", f"""
    WITH {_PAIRS},
    al AS (SELECT slug, unnest(CASE ord % 4 WHEN 0 THEN ['Moha ou Hammou'] WHEN 1 THEN ['Mohammed Sellam Ameziane'] ELSE ['Mohammed Sellam Ameziane', 'Moha ou Said'] END) AS alias FROM rec_people WHERE ord % 4 IN (0, 1, 2)),
    alk AS (SELECT slug, {_key('alias')} AS alias_key FROM al),
    sides AS (SELECT a_key AS mine, b AS other, b_key AS other_key FROM pairs UNION ALL SELECT b_key, a, a_key FROM pairs)
    SELECT 'error' AS severity, 'people' AS collection, o.slug AS slug, 'aliases' AS field, '"' || o.name || '" has for an alias "' || other || '", who is someone else' AS message
    FROM sides JOIN own ON own.key = mine JOIN alk ON alk.slug = o.slug AND alk.alias_key = other_key""", ("people",))
def name_conflations(t):
    # the records that own the declared names have no aliases of their own
    absorbed = F.array(F.lit("Mohammed Sellam Ameziane"), F.lit("Moha ou Said"))
    people = Snapshot(t)["people"].withColumn("aliases", F.when(F.col("ord") % 4 == 2, absorbed).otherwise(F.col("aliases")))
    return shown(R.conflations(people, SETTINGS))


@query("never_merged_names", f"""
    WITH n(name, x) AS (VALUES ('Sidi Mohamed Ben Hammou', 1)), k AS (SELECT name AS protected, {_key('name')} AS pk FROM n),
    p0 AS (SELECT slug, name, {S.match_fold('name')} AS f FROM rec_people), p AS (SELECT slug, array_to_string({S.fold_tokens('name', 'f')}, ' ') AS key FROM p0)
    SELECT 'error' AS severity, 'people' AS collection, slug, NULL AS field, '"' || protected || '" fits ' || count(*) OVER (PARTITION BY protected) || ' records' AS message
    FROM k JOIN p ON contains(key, pk) OR contains(pk, key) QUALIFY count(*) OVER (PARTITION BY protected) > 1""", ("people",))
def never_merged_names(t):
    return shown(R.never_merged(Snapshot(t)["people"], SETTINGS))


# ------------------------------------------------------------------ R06 – R11
@query("rule_verbatim_dates", """
    WITH v AS (SELECT slug, 'born' AS field, born AS v FROM rec_people UNION ALL SELECT slug, 'died', died FROM rec_people)
    SELECT 'error' AS severity, 'people' AS collection, slug, field, field || ' = "' || v || '" reads as a computed date' AS message
    FROM v WHERE regexp_matches(trim(v), '^\\d{4}-\\d{2}-\\d{2}(T|$)')""", ("people",))
def rule_verbatim_dates(t):
    return shown(R.r06(Snapshot(t), SETTINGS))


@query("rule_dispute_markers", f"""
    SELECT 'warn' AS severity, 'people' AS collection, slug, NULL AS field, 'The body grades no claim as open, though points are contested' AS message
    FROM rec_dossiers WHERE contestedPoints <> '' AND {S.strip("coalesce(body, '')")} <> '' AND NOT regexp_matches(body, '(?im)' || {quoted(fixed.DISPUTE_MARKER)})""", ("dossiers",))
def rule_dispute_markers(t):
    return shown(R.r07(Snapshot(t, "dossiers"), SETTINGS))


@query("rule_assessments", f"""
    WITH t AS (SELECT 'people' AS collection, slug, 'oneLine' AS field, oneLine AS text FROM rec_people UNION ALL SELECT 'events', slug, 'summary', summary FROM rec_incidents
               UNION ALL SELECT 'sources', slug, 'covers', covers FROM rec_sources UNION ALL SELECT 'sources', slug, 'biasNotes', biasNotes FROM rec_sources
               UNION ALL SELECT 'archives', slug, 'holdings', holdings FROM rec_archives UNION ALL SELECT 'relationships', slug, 'evidence', evidence FROM rec_relationships),
         m(marker) AS (VALUES {', '.join(f'({quoted(x)})' for x in fixed.OPINION_MARKERS)})
    SELECT 'error' AS severity, collection, slug, field, 'Opinion in evidence: "' || marker || '" in field ' || field AS message
    FROM t JOIN m ON regexp_matches(text, '(?i)\\b' || marker || '\\b')
    UNION ALL SELECT 'warn', 'people', slug, 'assessment', 'Nothing is named that would refute the assessment' FROM rec_people
    WHERE assessment <> '' AND NOT regexp_matches(assessment, '(?i)' || {quoted('|'.join(fixed.FALSIFIER_MARKERS))})
    UNION ALL SELECT 'error', 'sources', slug, NULL, 'The source seems to be an assessment' FROM rec_sources
    WHERE regexp_matches(concat_ws(' ', title, author, archivalReference, covers), '(?i)' || {quoted(fixed.ASSESSMENT_CITED)})""", _ALL)
def rule_assessments(t):
    return shown(R.r08(Snapshot(t), SETTINGS))


@query("rule_relations", """
    WITH s AS (SELECT slug, regexp_extract(name, '(\\S+)$', 1) AS surname FROM rec_people WHERE dossierStatus = 'Full dossier'),
         f AS (SELECT DISTINCT surname FROM (SELECT DISTINCT surname FROM s) JOIN rec_sources r ON contains(concat_ws(' ', covers, biasNotes, title), surname))
    SELECT 'warn' AS severity, 'relationships' AS collection, slug, 'from' AS field, 'Lost end: from = ' || coalesce(from_slug, 'null') AS message FROM rec_relationships
    WHERE from_slug IS NULL OR from_slug NOT IN (SELECT slug FROM rec_people)
    UNION ALL SELECT 'warn', 'relationships', slug, 'to', 'Lost end: to = ' || coalesce(to_slug, 'null') FROM rec_relationships WHERE to_slug IS NULL OR to_slug NOT IN (SELECT slug FROM rec_people)
    UNION ALL SELECT 'warn', 'relationships', slug, NULL, 'Relation to itself: ' || from_slug || ' → ' || to_slug FROM rec_relationships WHERE from_slug = to_slug
    UNION ALL SELECT 'info', 'events', slug, NULL, 'The event names nobody' FROM rec_incidents WHERE people = ''
    UNION ALL SELECT 'warn', 'people', slug, NULL, 'Full dossier, yet no source names "' || surname || '"' FROM s WHERE length(surname) >= 4 AND surname NOT IN (SELECT surname FROM f)""", _ALL)
def rule_relations(t):
    return shown(R.r09(Snapshot(t), SETTINGS))


def _staleness(days, full):
    return f"""
    WITH p AS (SELECT slug, dossierStatus AS d, lastReviewed, date_diff('day', TRY_CAST(lastReviewed AS DATE), DATE '2026-08-16') AS age,
                      CASE dossierStatus WHEN 'Full dossier' THEN {full} ELSE {days} END AS lim FROM rec_people)
    SELECT 'info' AS severity, 'people' AS collection, slug, 'lastReviewed' AS field, d || ' without any review date' AS message FROM p
    WHERE lastReviewed IS NULL AND d IN ('Full dossier', 'Substantial')
    UNION ALL SELECT 'info', 'people', slug, 'lastReviewed', 'Last review is ' || age || ' days old (' || d || ', limit ' || lim || ')' FROM p WHERE age > lim"""


@query("rule_staleness", _staleness(90, 60), ("people",))
def rule_staleness(t):
    return shown(R.r10(Snapshot(t), SETTINGS))


@query("stale_over_100_days", _staleness(100, 67), ("people",))
def stale_over_100_days(t):
    return shown(R.r10(Snapshot(t), SETTINGS.staleness(100)))


@query("rule_tiers", """
    SELECT 'warn' AS severity, 'sources' AS collection, slug, NULL AS field, 'Archival source of the first tier, not verified' AS message FROM rec_sources WHERE tier = 'PRIMARY_ARCHIVAL' AND verification = 'NOT YET VERIFIED'
    UNION ALL SELECT 'warn', 'sources', slug, NULL, 'Academic source "Consulted directly", but without URL' FROM rec_sources WHERE tier = 'ACADEMIC' AND verification = 'Consulted directly' AND sourceUrl IS NULL
    UNION ALL SELECT 'warn', 'sources', slug, 'verification', 'Verification is not recorded' FROM rec_sources WHERE verification IS NULL""", ("sources",))
def rule_tiers(t):
    return shown(R.r11(Snapshot(t), SETTINGS))


# ------------------------------------------------------------------ R12, R13
def _moves(before, after, field, values, label, own, collection):
    return f"""SELECT '{collection}' AS collection, a.slug, '{field}' AS field, '{label}' AS label, b.{field} AS was, a.{field} AS now, {own} AS own
      FROM {before} b JOIN {after} a USING (slug) WHERE list_position([{S.listed(values)}], a.{field}) > 0 AND list_position([{S.listed(values)}], b.{field}) > 0
        AND list_position([{S.listed(values)}], a.{field}) < list_position([{S.listed(values)}], b.{field})"""


_OWN = "coalesce(a.archivalReference, '') <> coalesce(b.archivalReference, '')"
_PAIR = ("people_before", "people_after", "sources_before", "sources_after")


def _monotonic(sources_before):
    return f"""
    WITH m AS ({_moves(sources_before, 'rec_sources_after', 'verification', fixed.SOURCE_VERIFICATION, 'Source verification', _OWN, 'sources')}
      UNION ALL {_moves(sources_before, 'rec_sources_after', 'tier', fixed.TIERS, 'Source tier', _OWN, 'sources')}
      UNION ALL {_moves('rec_people_before', 'rec_people_after', 'evidenceBase', fixed.LADDERS['evidenceBase'], 'Evidence base', 'false', 'people')}),
      n AS (SELECT count(*) AS n FROM rec_sources_after WHERE slug NOT IN (SELECT slug FROM {sources_before}))
    SELECT CASE WHEN own OR n > 0 THEN 'info' ELSE 'error' END AS severity, collection, slug, field,
           label || CASE WHEN own OR n > 0 THEN ' rose: ' ELSE ' rose without a new source: ' END || was || ' → ' || now AS message FROM m, n"""


class _People(Snapshot):
    """Only people and sources, in one of their two states."""

    def get(self, name):
        return super().get(name) if name in ("people", "sources") else None


@query("rule_monotonicity", _monotonic("rec_sources_before"), _PAIR)
def rule_monotonicity(t):
    return shown(R.r12(_People(t, "people_after", "sources_after"), SETTINGS, _People(t, "people_before", "sources_before")))


@query("rule_monotonicity_no_new_source", _monotonic("rec_sources"), _PAIR + ("sources",))
def rule_monotonicity_no_new_source(t):
    return shown(R.r12(_People(t, "people_after", "sources_after"), SETTINGS, _People(t, "people_before", "sources")))


_RANGES = lambda x, g: f"regexp_extract_all({x}, '(?i)(?:^|[^0-9.,])([0-9][0-9,]*)\\s*(?:[–—-]|to|and)\\s*([0-9][0-9,]*)(?:[^0-9.,]|$)', {g})"


@query("rule_range_collapse", f"""
    WITH t AS (SELECT slug, 'oneLine' AS field, b.oneLine AS was, a.oneLine AS now FROM rec_people_before b JOIN rec_people_after a USING (slug)
               UNION ALL SELECT slug, 'contestedPoints', b.contestedPoints, a.contestedPoints FROM rec_people_before b JOIN rec_people_after a USING (slug)
               UNION ALL SELECT slug, 'body', b.body, a.body FROM rec_people_before b JOIN rec_people_after a USING (slug)),
         r AS (SELECT slug, field, coalesce(now, '') AS now, unnest({_RANGES('was', 1)}) AS low, unnest({_RANGES('was', 2)}) AS high,
                      list_transform({_RANGES("coalesce(now, '')", 1)}, lambda x, i: replace(x, ',', '') || '-' || replace(({_RANGES("coalesce(now, '')", 2)})[i], ',', '')) AS kept
               FROM t WHERE was <> '' AND was IS DISTINCT FROM now),
         s AS (SELECT *, list_filter([low, high], lambda n: {_ALONE('now', "'(' || n || '|' || replace(n, ',', '') || ')'")}) AS survivors FROM r
               WHERE CAST(replace(high, ',', '') AS DOUBLE) > CAST(replace(low, ',', '') AS DOUBLE) AND NOT list_contains(kept, replace(low, ',', '') || '-' || replace(high, ',', '')))
    SELECT 'error' AS severity, 'people' AS collection, slug, field, 'Range ' || low || '–' || high || ' shrank to ' || array_to_string(survivors, ' / ') AS message FROM s WHERE len(survivors) > 0""",
       ("people_before", "people_after"))
def rule_range_collapse(t):
    people = lambda name: {"people": t[name]}
    return shown(R.r13(people("people_after"), SETTINGS, people("people_before")))


# ------------------------------------------------------------------ publishing rules
_PUBLISH = [(c, f, a, False, (c, f) not in fixed.PUBLISH_NULL_WARNS) for c, f, a in fixed.PUBLISH_CHECKS]


@query("publish_vocabulary", f"""
    WITH bad AS ({_vocabulary_sql(_PUBLISH, _TABLES)})
    SELECT CASE WHEN v IS NULL THEN 'warn' ELSE 'error' END AS severity, collection, slug, field,
      CASE WHEN v IS NULL THEN slug || ' has no ' || field ELSE slug || ' has ' || field || '="' || v || '", which is outside the vocabulary' END AS message FROM bad""", _ALL)
def publish_vocabulary(t):
    return shown(R.published_vocabulary(Snapshot(t)))


def _figure_pages(t):
    """The test pages, some with a published range, some with a bare figure."""
    block = F.concat(F.lit('<figure class="frange"><b class="frange__label">Losses '), (F.col("page_id") % 4).cast("string"),
                     F.lit('</b><i class="frange__n">'), F.format_number(1000 + F.col("page_id") % 40, 0), F.lit('</i><i class="frange__n">'),
                     F.format_number(9000 + F.col("page_id") % 40, 0), F.lit("</i></figure>"))
    line = F.concat(F.lit("<p>They lost "), F.format_number(1000 + F.col("page_id") % 60, 0), F.lit(" men.</p><p>The count was "),
                    (9000 + F.col("page_id") % 50).cast("string"), F.lit(".</p>"))
    extra = F.when(F.col("page_id") % 7 == 0, block).otherwise(line)
    return t.pages.withColumn("html", F.concat("html", extra))


@query("publish_bare_figures", """
    WITH m AS (SELECT page_id, 1000 + page_id % 40 AS lo, 9000 + page_id % 40 AS hi, page_id % 4 AS k FROM pages WHERE page_id % 7 = 0),
         f AS (SELECT v, max_by(k, page_id) AS k FROM (SELECT lo AS v, k, page_id FROM m UNION ALL SELECT hi, k, page_id FROM m) GROUP BY v)
    SELECT DISTINCT 'error' AS severity, 'pages' AS collection, url || ': shows only ' || replace(format('{:,}', v), '.', ',') || ' of the range "Losses ' || k || '"' AS message
    FROM pages JOIN f ON f.v = 1000 + page_id % 60 WHERE page_id % 7 <> 0 AND page_id % 60 <> page_id % 50""")
def publish_bare_figures(t):
    return R.published_bare_figures(_figure_pages(t)).select("severity", "collection", "message")


@query("publish_disputes", """
    SELECT 'warn' AS severity, 'people' AS collection, slug, NULL AS field, slug || ': points are contested, but no claim is graded Disputed' AS message
    FROM rec_people p WHERE contestedPoints <> '' AND ord IN (SELECT doc_id FROM documents) AND ord % 7 NOT IN (2, 3)""", ("people",))
def publish_disputes(t):
    return shown(R.contested_without_dispute(t.people, t.bodies, C.extract_claims(t.bodies)))


_CLAIM_PAGES = """c AS (SELECT DISTINCT slug, whatTheDocumentSays AS w, archivalReference AS r, dispute_no FROM rec_claims)"""


def _claim_pages(t):
    """A built page per claim: some say what is missing, some quote, some are absent."""
    k = F.col("dispute_no") % 5
    html = (F.when(k == 0, "<p>Not yet consulted directly. NOT YET VERIFIED</p>").when(k == 1, "<p>Text</p>")
            .when(k == 2, '<p>not yet consulted directly</p><blockquote class="verbatim">x</blockquote>').otherwise("<p>NOT YET VERIFIED</p>"))
    claims = t.claims.dropDuplicates(["slug"])
    return claims, claims.where(k != 4).select("slug", html.alias("html"))


@query("publish_quotations", f"""
    WITH {_CLAIM_PAGES}, u AS (SELECT slug, dispute_no % 5 AS k FROM c WHERE coalesce(trim(w), '') = '' OR regexp_matches(trim(w), '(?i)^not (yet consulted|applicable)')),
    x(k, what) AS (VALUES (1, 'no document was read, and the page does not say it'), (2, 'quotes a document that nobody read'),
                   (3, 'no document was read, and the page does not say it'), (4, 'page missing'))
    SELECT 'error' AS severity, 'claim-records' AS collection, slug, NULL AS field, slug || ': ' || what AS message FROM u JOIN x USING (k)""", ("claims",))
def publish_quotations(t):
    return shown(R.quotation_honesty(*_claim_pages(t)))


@query("publish_references", f"""
    WITH {_CLAIM_PAGES}
    SELECT 'error' AS severity, 'claim-records' AS collection, slug, NULL AS field, slug || ': the page hides that its reference is NOT YET VERIFIED' AS message
    FROM c WHERE r LIKE 'ARCHIVAL REFERENCE NOT YET VERIFIED%' AND dispute_no % 5 IN (1, 2)""", ("claims",))
def publish_references(t):
    return shown(R.reference_honesty(*_claim_pages(t)))


@query("publish_unverified_elements", """
    SELECT page_id, CAST(1 AS BIGINT) AS element FROM pages WHERE page_id % 3 = 1""")
def publish_unverified_elements(t):
    """Nested elements marked unverified; a third of the pages leave the words out."""
    words = F.when(F.col("page_id") % 3 == 1, "<b>no</b>").otherwise("<b>NOT YET VERIFIED</b>")
    marked = F.concat(F.lit('<div data-verification="NOT YET VERIFIED"><div>a</div><span>'), words, F.lit("</span></div><p>NOT YET VERIFIED</p>"))
    from probatum.operators.markup import unverified_elements
    return unverified_elements(t.pages.withColumn("html", F.concat("html", marked)), "page_id")
