"""Snapshot comparison, name matching, search, tallies and lists."""

from datetime import date

from pyspark.sql import functions as F

from probatum import fixed
from probatum.functions.names import parse_aliases
from probatum.operators import matching as M
from probatum.operators import search as Q
from probatum.operators import snapshots as D
from probatum.operators import tallies as A
from probatum.operators.scale import placed

from workload import sqltext as S
from workload.quality import Snapshot
from workload.records import quoted
from workload.registry import query

# ------------------------------------------------------------------ snapshots of orders
_MOVED = "CASE WHEN o_orderkey % 7 = 0 THEN CASE o_orderpriority WHEN '1-URGENT' THEN '2-HIGH' WHEN '5-LOW' THEN '3-MEDIUM' ELSE o_orderpriority END ELSE o_orderpriority END"


def _orders(t):
    moved = F.when(F.col("o_orderpriority") == "1-URGENT", "2-HIGH").when(F.col("o_orderpriority") == "5-LOW", "3-MEDIUM").otherwise(F.col("o_orderpriority"))
    after = t.orders.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, moved).otherwise(F.col("o_orderpriority")))
    return t.orders.where("o_orderkey % 17 <> 0"), after.where("o_orderkey % 13 <> 0")


@query("changed_orders", f"""
    WITH b AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0), a AS (SELECT o_orderkey, {_MOVED} AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'edited' END AS kind
    FROM b FULL JOIN a USING (o_orderkey) WHERE a.o_orderpriority IS DISTINCT FROM b.o_orderpriority""")
def changed_orders(t):
    return D.changed_keys(*_orders(t), key="o_orderkey")


@query("edited_order_fields", f"""
    SELECT o_orderkey, 'o_orderpriority' AS field, o_orderpriority AS before, {_MOVED} AS after FROM orders
    WHERE o_orderkey % 17 <> 0 AND o_orderkey % 13 <> 0 AND {_MOVED} <> o_orderpriority""")
def edited_order_fields(t):
    before, after = _orders(t)
    keys = D.changed_keys(before, after, "o_orderkey")
    return D.edited_fields(before, after, keys, "o_orderkey").select("o_orderkey", "field", "before", "after")


# columns that one side alone has, and hashes that move without a field
_REV = {"before": "o_orderkey % 3", "after": "o_orderkey % 5"}


def _ranked(t):
    """Orders with a column that went and one that came; the stored hashes move by the key alone."""
    was = t.orders.select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 4).cast("string").alias("shelf"), (F.col("o_orderkey") % 3).alias("hash"))
    now = t.orders.select("o_orderkey", "o_orderstatus", F.lower("o_orderpriority").alias("urgency"), (F.col("o_orderkey") % 5).alias("hash"))
    return was, now


@query("union_field_edits", f"""
    WITH m AS (SELECT o_orderkey, CAST(o_orderkey % 4 AS VARCHAR) AS shelf, lower(o_orderpriority) AS urgency FROM orders WHERE {_REV['before']} <> {_REV['after']})
    SELECT o_orderkey, 'shelf' AS field, shelf AS before, NULL AS after FROM m
    UNION ALL SELECT o_orderkey, 'urgency', NULL, urgency FROM m""")
def union_field_edits(t):
    before, after = _ranked(t)
    keys = D.changed_keys(before, after, "o_orderkey")
    return D.edited_fields(before, after, keys, "o_orderkey").select("o_orderkey", "field", "before", "after")


@query("moved_hash_edits", f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'added' WHEN o_orderkey % 13 = 0 THEN 'removed' ELSE 'edited' END AS kind FROM orders
    WHERE (o_orderkey % 17 = 0) <> (o_orderkey % 13 = 0)
       OR o_orderkey % 17 <> 0 AND o_orderkey % 13 <> 0 AND {_REV['before']} <> {_REV['after']} AND {_MOVED} <> o_orderpriority""")
def moved_hash_edits(t):
    before, after = (df.withColumn("hash", F.col("o_orderkey") % n) for df, n in zip(_orders(t), (3, 5)))
    return D.changed_keys(before, after, "o_orderkey")


@query("change_volume", """
    WITH c AS (SELECT CASE WHEN b.slug IS NULL THEN 'added' WHEN a.slug IS NULL THEN 'removed' ELSE 'edited' END AS kind
      FROM rec_people_before b FULL JOIN rec_people_after a USING (slug)
      WHERE b.slug IS NULL OR a.slug IS NULL OR a.evidenceBase IS DISTINCT FROM b.evidenceBase OR a.assessment IS DISTINCT FROM b.assessment
         OR a.oneLine IS DISTINCT FROM b.oneLine OR a.contestedPoints IS DISTINCT FROM b.contestedPoints)
    SELECT 'people' AS collection, kind, count(*) AS n FROM c GROUP BY kind""", ("people_before", "people_after"))
def change_volume(t):
    rows = D.changes("people", t.people_before, t.people_after, "name")
    return rows.groupBy("collection", "kind").agg(F.count(F.lit(1)).alias("n"))


_BESIDE = lambda x, h: f"regexp_matches({x}, '(?i)\\b{h}\\b[^.]{{0,40}}?\\d|\\d[^.]{{0,40}}?\\b{h}\\b')"


@query("suspicious_people", f"""
    WITH j AS (SELECT a.slug, a.name, b.assessment AS ba, a.assessment AS aa, b.contestedPoints AS bc, a.contestedPoints AS ac, b.oneLine AS bo, a.oneLine AS ao
               FROM rec_people_before b JOIN rec_people_after a USING (slug)),
         h(hedge, re) AS (VALUES {', '.join(f"({quoted(x)}, {quoted(x.replace('.', chr(92) + '.'))})" for x in fixed.HEDGES)})
    SELECT 'error' AS severity, slug, NULL AS field, 'Record deleted: "' || name || '"' AS message FROM rec_people_before WHERE slug NOT IN (SELECT slug FROM rec_people_after)
    UNION ALL SELECT CASE WHEN coalesce(aa, '') = '' THEN 'error' ELSE 'warn' END, slug, 'assessment', CASE WHEN coalesce(aa, '') = '' THEN 'Assessment taken away: "' ELSE 'Assessment is another now: "' END || name || '"' FROM j WHERE ba IS DISTINCT FROM aa
    UNION ALL SELECT 'error', slug, 'contestedPoints', 'Contested points gone from "' || name || '"' FROM j WHERE bc <> '' AND coalesce(ac, '') = ''
    UNION ALL SELECT 'warn', slug, 'oneLine', 'Hedge "' || hedge || '" removed from beside a number on "' || name || '"' FROM j, h
      WHERE bo <> ao AND regexp_matches(bo, '(?i)\\b' || re || '\\b[^.]{{0,40}}?\\d|\\d[^.]{{0,40}}?\\b' || re || '\\b') AND NOT regexp_matches(ao, '(?i)\\b' || re || '\\b[^.]{{0,40}}?\\d|\\d[^.]{{0,40}}?\\b' || re || '\\b')""",
       ("people_before", "people_after"))
def suspicious_people(t):
    return D.suspicious("people", t.people_before, t.people_after, "name").select("severity", "slug", "field", "message")


@query("suspicious_sources", """
    SELECT 'error' AS severity, slug, NULL AS field, 'Record deleted: "' || title || '"' AS message FROM rec_sources WHERE slug NOT IN (SELECT slug FROM rec_sources_after)
    UNION ALL SELECT 'warn', slug, 'archivalReference', 'Other archival reference, same verification: "' || a.title || '"' FROM rec_sources b JOIN rec_sources_after a USING (slug)
    WHERE a.archivalReference IS DISTINCT FROM b.archivalReference AND a.verification IS NOT DISTINCT FROM b.verification""", ("sources", "sources_after"))
def suspicious_sources(t):
    return D.suspicious("sources", t.sources, t.sources_after, "title").select("severity", "slug", "field", "message")


# ------------------------------------------------------------------ names
_FORMS = f"""
    p0 AS (SELECT slug, name, {S.match_fold('name')} AS f FROM rec_people),
    p AS (SELECT slug, array_to_string({S.fold_tokens('name', 'f')}, ' ') AS key, replace({S.fold_ordered('name', 'f')}, ' ', '') AS compact, {S.arabic('name')} AS arabic FROM p0),
    forms AS (SELECT key, compact, arabic, count(*) AS n, list_distinct(string_split(key, ' ')) AS tokens FROM p WHERE key <> '' GROUP BY ALL)"""


@query("similar_names", f"""
    WITH {_FORMS},
    x AS (SELECT a.key || '|' || a.compact AS fa, b.key || '|' || b.compact AS fb, a.compact AS ca, b.compact AS cb, len(list_intersect(a.tokens, b.tokens)) AS i, len(a.tokens) AS na, len(b.tokens) AS nb, a.n * b.n AS pairs
          FROM forms a JOIN forms b ON a.key || '|' || a.compact < b.key || '|' || b.compact AND a.key <> b.key AND a.arabic = b.arabic),
    s AS (SELECT fa, fb, pairs, (0.45 * {S.jaro_winkler('ca', 'cb')} + 0.55 * (i / (na + nb - i))) * CASE WHEN i = least(na, nb) AND na <> nb THEN 0.55 ELSE 1 END AS score FROM x WHERE i > 0 AND (0.45 + 0.55 * (i / (na + nb - i))) * CASE WHEN i = least(na, nb) AND na <> nb THEN 0.55 ELSE 1 END >= 0.72)
    SELECT fa AS form_a, fb AS form_b, CAST(pairs AS BIGINT) AS pairs, round(score, 6) AS score FROM s WHERE score >= 0.72""", ("people",))
def similar_names(t):
    pairs = M.similar_forms(M.name_forms(t.people))
    return pairs.select(F.col("a_form").alias("form_a"), F.col("b_form").alias("form_b"), (F.col("a_n") * F.col("b_n")).alias("pairs"), F.round("score", 6).alias("score"))


@query("same_names", f"""
    WITH {_FORMS}
    SELECT key, CAST(sum(n) AS BIGINT) AS records, CAST(sum(n) * (sum(n) - 1) / 2 AS BIGINT) AS pairs FROM forms GROUP BY key HAVING sum(n) > 1""", ("people",))
def same_names(t):
    rows = M.duplicate_proposals(t.people).where("a_form = b_form")
    return rows.select(F.col("a_key").alias("key"), F.col("a_n").alias("records"), "pairs")


@query("duplicate_findings", f"""
    WITH p0 AS (SELECT slug, name, {S.match_fold('name')} AS f FROM rec_people),
    p AS (SELECT slug, name, array_to_string({S.fold_tokens('name', 'f')}, ' ') AS key, replace({S.fold_ordered('name', 'f')}, ' ', '') AS compact, {S.arabic('name')} AS arabic FROM p0),
    forms AS (SELECT key, compact, arabic, min(struct_pack(slug := slug, name := name)) AS h, max(struct_pack(slug := slug, name := name)) AS g, count(*) AS n, list_distinct(string_split(key, ' ')) AS tokens FROM p WHERE key <> '' GROUP BY key, compact, arabic),
    d(a, b) AS (VALUES {', '.join(f"({quoted(a)}, {quoted(b)})" for a, b in fixed.KNOWN_DISTINCT)}),
    apart AS (SELECT array_to_string({S.fold_tokens('a', S.match_fold('a'))}, ' ') AS x, array_to_string({S.fold_tokens('b', S.match_fold('b'))}, ' ') AS y FROM d),
    x AS (SELECT a.h AS ah, b.h AS bh, a.key || '|' || a.compact AS fa, b.key || '|' || b.compact AS fb, a.compact AS ca, b.compact AS cb, len(list_intersect(a.tokens, b.tokens)) AS i, len(a.tokens) AS na, len(b.tokens) AS nb, a.n * b.n AS pairs
          FROM forms a JOIN forms b ON a.key || '|' || a.compact < b.key || '|' || b.compact AND a.key <> b.key AND a.arabic = b.arabic
          WHERE NOT EXISTS (FROM apart WHERE (x = a.key AND y = b.key) OR (y = a.key AND x = b.key))),
    s AS (SELECT *, (0.45 * {S.jaro_winkler('ca', 'cb')} + 0.55 * (i / (na + nb - i))) * CASE WHEN i = least(na, nb) AND na <> nb THEN 0.55 ELSE 1 END AS score FROM x
          WHERE i > 0 AND (0.45 + 0.55 * (i / (na + nb - i))) * CASE WHEN i = least(na, nb) AND na <> nb THEN 0.55 ELSE 1 END >= 0.72),
    found AS (SELECT ah, bh, fa, fb, pairs, score, i = least(na, nb) AND na <> nb AS extends FROM s WHERE score >= 0.72
        UNION ALL SELECT min(h), max(g), key, key, sum(n) * (sum(n) - 1) / 2, 1, false FROM forms GROUP BY key HAVING sum(n) > 1)
    SELECT 'warn' AS severity, ah.slug AS slug, 'Look alike: "' || ah.name || '" and "' || bh.name || '" (score ' || printf('%.2f', score) || ')' AS message,
           'record pairs: ' || pairs::BIGINT || '; forms: ' || fa || ' / ' || fb || CASE WHEN extends THEN '; one name extends the other' ELSE '' END AS detail FROM found""", ("people",))
def duplicate_findings(t):
    from probatum.operators import rules as R
    from workload.quality import SETTINGS
    return R.likely_duplicates(t.people, SETTINGS).select("severity", "slug", "message", "detail")


def _questions(t):
    """Names to look up: every supplier asks for a name in one of many spellings."""
    words = ["Azayyi", "Zaiani", "Mohamed Ameziane", "Raïssouni", "Khattabi Mouha", "Hammou Tazi", "el Glaoui", "Abd", "محا"]
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("s_suppkey") % len(words) + 1).cast("int"))
    tag = F.translate((F.floor(F.col("s_suppkey") / 3)).cast("string"), "0123456789", "abdefghlmn")
    asked = F.when(F.col("s_suppkey") % 2 == 0, word).otherwise(F.concat_ws(" ", word, tag))
    return t.supplier.select(F.col("s_suppkey").alias("qid"), asked.alias("query"))


_ASKED = """q0 AS (SELECT s_suppkey AS qid, (CASE s_suppkey % 9 WHEN 0 THEN 'Azayyi' WHEN 1 THEN 'Zaiani' WHEN 2 THEN 'Mohamed Ameziane' WHEN 3 THEN 'Raïssouni' WHEN 4 THEN 'Khattabi Mouha'
        WHEN 5 THEN 'Hammou Tazi' WHEN 6 THEN 'el Glaoui' WHEN 7 THEN 'Abd' ELSE 'محا' END) ||
        CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' ' || translate(CAST(CAST(floor(s_suppkey / 3) AS BIGINT) AS STRING), '0123456789', 'abdefghlmn') END AS query FROM supplier)"""


@query("resolved_names", f"""
    WITH {_FORMS}, {_ASKED},
    q1 AS (SELECT qid, query, {S.match_fold('query')} AS f FROM q0),
    q AS (SELECT qid, array_to_string({S.fold_tokens('query', 'f')}, ' ') AS qk, replace({S.fold_ordered('query', 'f')}, ' ', '') AS qc, {S.arabic('query')} AS qa FROM q1),
    u AS (SELECT *, list_distinct(string_split(qk, ' ')) AS qt FROM (SELECT DISTINCT qk, qc, qa FROM q WHERE qk <> '')),
    x AS (SELECT u.*, forms.*, len(list_intersect(qt, tokens)) AS i, len(qt) AS na, len(tokens) AS nb FROM u, forms),
    s AS (SELECT *, greatest(CASE WHEN qa <> arabic THEN 0 WHEN qk = key THEN 1 ELSE (0.45 * {S.jaro_winkler('qc', 'compact')} + 0.55 * (i / (na + nb - i))) * CASE WHEN i = least(na, nb) AND na <> nb THEN 0.55 ELSE 1 END END,
             CASE WHEN i = na THEN 0.85 WHEN contains(key, qk) OR contains(qk, key) THEN 0.6 + 0.4 * least(length(key), length(qk)) / greatest(length(key), length(qk)) ELSE 0 END) AS score FROM x)
    SELECT qid, p.slug, round(score, 6) AS score FROM s JOIN q USING (qk, qc) JOIN p ON p.key = s.key AND p.compact = s.compact WHERE score >= 0.72""", ("people",))
def resolved_names(t):
    index = t.people.select("slug", F.col("name").alias("display"), F.lit(0).alias("pos"), "name")
    hits = M.resolve_aliases(_questions(t), index)
    return hits.select("qid", "slug", F.round("score", 6).alias("score"))


@query("name_advice", """
    WITH h AS (SELECT o_orderkey % 100 AS qid, CASE CASE WHEN o_orderkey % 100 < 50 THEN o_orderkey % 7 ELSE 3 + o_orderkey % 4 END WHEN 0 THEN 'Moha ou Said' WHEN 1 THEN 'Mouha ou Hammou Zayani' WHEN 2 THEN 'Sidi Ali' ELSE 'X' || o_custkey END AS display FROM orders),
         g AS (SELECT qid, count(*) AS n, bool_or(display = 'Moha ou Said') AS a, bool_or(display = 'Mouha ou Hammou Zayani') AS b, bool_or(contains(display, 'Sidi')) AS c FROM h GROUP BY qid)
    SELECT qid, 'known distinct: Moha ou Said / Mouha ou Hammou Zayani' AS advice FROM g WHERE n > 1 AND a AND b
    UNION ALL SELECT qid, 'never merge: Sidi Mohamed Ben Hammou' FROM g WHERE n > 1 AND c""")
def name_advice(t):
    kind = F.when(F.col("o_orderkey") % 100 < 50, F.col("o_orderkey") % 7).otherwise(3 + F.col("o_orderkey") % 4)
    display = (F.when(kind == 0, "Moha ou Said").when(kind == 1, "Mouha ou Hammou Zayani").when(kind == 2, "Sidi Ali")
               .otherwise(F.concat(F.lit("X"), F.col("o_custkey").cast("string"))))
    hits = t.orders.select((F.col("o_orderkey") % 100).alias("qid"), display.alias("display"))
    return M.distinctness_advice(hits, fixed.KNOWN_DISTINCT, fixed.NEVER_MERGE)


# ------------------------------------------------------------------ search
def _index(t):
    people = t.people.withColumn("aliases", parse_aliases(F.col("aliasesRaw"))).withColumn("phase", F.split("phase", "[|]"))
    return Q.build_index(people=people, events=t.incidents, sources=t.sources, archives=t.archives)


_CUST = "'Customer#' || lpad(CAST(ord AS STRING), 9, '0')"
_SEARCH = f"""
    terms AS (SELECT 'person' AS type, slug, name AS term, true AS f FROM rec_people
      UNION ALL SELECT 'person', slug, unnest(CASE ord % 4 WHEN 0 THEN ['Moha ou Hammou', 'le caïd ' || {_CUST}, 'des Zaïanes', 'Muḥa'] WHEN 1 THEN ['Mohammed Sellam Ameziane', {_CUST}] WHEN 3 THEN ['محا أو حمو ' || {_CUST}] ELSE [] END), true FROM rec_people
      UNION ALL SELECT 'event', slug, event, true FROM rec_incidents UNION ALL SELECT 'event', slug, location, true FROM rec_incidents
      UNION ALL SELECT 'source', slug, title, true FROM rec_sources UNION ALL SELECT 'source', slug, author, true FROM rec_sources UNION ALL SELECT 'source', slug, archivalReference, false FROM rec_sources
      UNION ALL SELECT 'archive', slug, institution, true FROM rec_archives UNION ALL SELECT 'archive', slug, city, true FROM rec_archives UNION ALL SELECT 'archive', slug, country, true FROM rec_archives UNION ALL SELECT 'archive', slug, fonds, false FROM rec_archives),
    ft AS (SELECT type, slug, term, CASE WHEN f THEN {S.search_fold('term')} END AS folded FROM terms WHERE term <> '')"""
_QUERIES = """qs0 AS (SELECT n_nationkey AS qid, CASE n_nationkey % 8 WHEN 0 THEN 'zaïanes' WHEN 1 THEN 'MUHA' WHEN 2 THEN 'NATION_' || n_nationkey WHEN 3 THEN 'Brand#' || n_nationkey WHEN 4 THEN 'caja 81'
      WHEN 5 THEN 'Customer#0000000' || (10 + n_nationkey) WHEN 6 THEN 'Ameziane' ELSE 'محا أو' END AS raw FROM nation)"""


def _asked(t):
    n = F.col("n_nationkey")
    s = n.cast("string")
    raw = F.element_at(F.array(F.lit("zaïanes"), F.lit("MUHA"), F.concat(F.lit("NATION_"), s), F.concat(F.lit("Brand#"), s), F.lit("caja 81"),
                               F.concat(F.lit("Customer#0000000"), (n + 10).cast("string")), F.lit("Ameziane"), F.lit("محا أو")), n % 8 + 1)
    return t.nation.select(n.alias("qid"), raw.alias("raw"))


_SCORED = f"""{_SEARCH}, {_QUERIES},
    qs AS (SELECT qid, raw, {S.search_fold('raw')} AS q FROM qs0),
    sc AS (SELECT qid, type, slug, max(CASE WHEN folded = q OR term = raw THEN 100 WHEN starts_with(folded, q) THEN 70 WHEN contains(term, raw) THEN 60 WHEN contains(folded, q) THEN 45 END) AS score
           FROM qs JOIN ft ON contains(folded, q) OR contains(term, raw) GROUP BY ALL)"""
_SEARCHED = ("people", "incidents", "sources", "archives")


@query("search_terms", f"""
    WITH {_SEARCH}
    SELECT DISTINCT type, slug, folded FROM ft WHERE folded <> ''""", _SEARCHED)
def search_terms(t):
    return _index(t).select("type", "slug", F.explode("folded").alias("folded"))


@query("search_scores", f"""
    WITH {_SCORED}
    SELECT qid, type, slug, score FROM sc""", _SEARCHED)
def search_scores(t):
    return Q.score_records(_index(t), _asked(t))


@query("search_results", f"""
    WITH {_SCORED},
    titled AS (SELECT 'person' AS type, slug, name AS title FROM rec_people UNION ALL SELECT 'event', slug, event FROM rec_incidents UNION ALL SELECT 'source', slug, title FROM rec_sources UNION ALL SELECT 'archive', slug, institution FROM rec_archives),
    r AS (SELECT qid, type, slug, title, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, title, type, slug) AS rank FROM sc JOIN titled USING (type, slug))
    SELECT qid, CAST(rank AS INTEGER) AS rank, type, slug, title, score FROM r WHERE rank <= 60""", _SEARCHED)
def search_results(t):
    return Q.ranked(_index(t), _asked(t)).drop("via")


@query("search_people_of_phase", f"""
    WITH {_SCORED},
    r AS (SELECT qid, slug, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name, slug) AS rank FROM sc JOIN rec_people p USING (slug) WHERE type = 'person' AND phase = 'IV 1912-1921')
    SELECT qid, CAST(rank AS INTEGER) AS rank, slug, score FROM r WHERE rank <= 60""", _SEARCHED)
def search_people_of_phase(t):
    return Q.ranked(_index(t), _asked(t), types=["person"], phase="IV 1912-1921").select("qid", "rank", "slug", "score")


@query("search_best", f"""
    WITH {_SCORED},
    o AS (SELECT qid, slug, score, ord FROM sc JOIN (SELECT 'person' AS type, slug, ord FROM rec_people) USING (type, slug)),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM o)
    SELECT qid, slug, score FROM r WHERE rank = 1""", _SEARCHED)
def search_best(t):
    people = t.people.withColumn("aliases", parse_aliases(F.col("aliasesRaw"))).withColumn("phase", F.split("phase", "[|]"))
    index = Q.build_index(people=people).join(people.select("slug", "ord"), "slug")
    return Q.best_match(index, _asked(t)).select("qid", "slug", "score")


# ------------------------------------------------------------------ tallies
def _zeros(values):
    return ", ".join(f"({quoted(v)})" for v in values)


@query("strength_tally", f"""
    WITH v(value) AS (VALUES {_zeros(fixed.EVIDENCE_STRENGTH)}), n AS (SELECT evidenceStrength AS value, count(*) AS n FROM rec_relationships GROUP BY 1)
    SELECT value, coalesce(n, 0) AS n FROM v FULL JOIN n USING (value)""", ("relationships",))
def strength_tally(t):
    return A.tallies(t.relationships, {"s": ("evidenceStrength", fixed.EVIDENCE_STRENGTH)}).drop("dimension")


def _tally_sql(dimension, table, column, vocabulary):
    return f"""SELECT '{dimension}' AS dimension, value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT coalesce({column}, '(not recorded)') AS value, count(*) AS n FROM {table} GROUP BY 1
        UNION ALL SELECT unnest([{S.listed(vocabulary)}]), 0) GROUP BY value"""


@query("corpus_health", f"""
    SELECT 'counts' AS dimension, 'People' AS value, count(*) AS n FROM rec_people UNION ALL SELECT 'counts', 'Events', count(*) FROM rec_incidents
    UNION ALL SELECT 'counts', 'Sources', count(*) FROM rec_sources UNION ALL SELECT 'counts', 'Archives', count(*) FROM rec_archives UNION ALL SELECT 'counts', 'Relationships', count(*) FROM rec_relationships
    UNION ALL {_tally_sql('dossierStatus', 'rec_people', 'dossierStatus', fixed.DOSSIER_STATUS)} UNION ALL {_tally_sql('evidenceBase', 'rec_people', 'evidenceBase', fixed.EVIDENCE_BASE)}
    UNION ALL {_tally_sql('impactByValue', 'rec_people', 'impact', fixed.IMPACT)} UNION ALL {_tally_sql('sourceVerification', 'rec_sources', 'verification', fixed.SOURCE_VERIFICATION)}
    UNION ALL {_tally_sql('tiers', 'rec_sources', 'tier', fixed.TIERS)} UNION ALL {_tally_sql('archiveVerification', 'rec_archives', 'verification', fixed.ARCHIVE_VERIFICATION)}
    UNION ALL SELECT 'impact', 'rated', count(*) FILTER (impact <> '') FROM rec_people UNION ALL SELECT 'impact', 'total', count(*) FROM rec_people
    UNION ALL SELECT 'assessments', 'written', count(*) FILTER (assessment <> '') FROM rec_people UNION ALL SELECT 'assessments', 'total', count(*) FROM rec_people
    UNION ALL SELECT 'assessments', 'withFalsifier', count(*) FILTER (regexp_matches(assessment, '(?i)' || {quoted(fixed.HEALTH_FALSIFIER)})) FROM rec_people
    UNION ALL SELECT 'stale', 'stale', count(*) FILTER (date_diff('day', TRY_CAST(lastReviewed AS DATE), DATE '2026-08-16') > 90) FROM rec_people""",
       ("people", "incidents", "sources", "archives", "relationships"))
def corpus_health(t):
    return A.health(Snapshot(t), date(2026, 8, 16))


@query("label_coverage", """
    SELECT coalesce(CAST(quality AS STRING), 'Not recorded') AS quality, count(*) AS n, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS toxic,
           CAST(floor(100 * count(*) / (SELECT count(*) FROM documents) + 0.5) AS BIGINT) AS percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def label_coverage(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left").withColumn("quality", F.col("quality").cast("string"))
    return A.with_share(A.grouped(joined, "quality", toxic=F.count_if(F.col("toxic") == 1)))


@query("table_counts", """
    SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents
    UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events""")
def table_counts(t):
    return A.counts({n: t[n] for n in ("orders", "lineitem", "documents", "conversations", "events")})


@query("archives_by_country", """
    SELECT country, count(*) AS n, count(*) FILTER (priority = '1 - decisive') AS decisive FROM rec_archives GROUP BY country""", ("archives",))
def archives_by_country(t):
    return A.by_country(t.archives)


@query("disputes_by_status", """
    SELECT CASE WHEN status IN ('Settleable - request identified', 'Resolved') THEN status ELSE 'Status not recorded' END AS value, count(*) AS n,
           CAST(CASE status WHEN 'Settleable - request identified' THEN 0 WHEN 'Resolved' THEN 1 ELSE 2 END AS BIGINT) AS place FROM rec_disputes GROUP BY ALL""", ("disputes",))
def disputes_by_status(t):
    return A.by_vocabulary_order(t.disputes, "status", ["Settleable - request identified", "Resolved"], "Status not recorded")


@query("events_by_phase", f"""
    SELECT coalesce(list_position([{S.listed(fixed.PHASES)}], phase) - 1, {len(fixed.PHASES)}) AS place, CASE WHEN phase IN ({S.listed(fixed.PHASES)}) THEN phase ELSE 'Other' END AS value, count(*) AS n
    FROM rec_incidents GROUP BY ALL""", ("incidents",))
def events_by_phase(t):
    return A.by_vocabulary_order(t.incidents, "phase", fixed.PHASES, "Other").select(F.col("place").cast("bigint").alias("place"), "value", "n")


@query("claims_by_confidence", """
    SELECT coalesce(confidence, 'Not recorded') AS confidence, count(*) AS n FROM rec_claims GROUP BY 1""", ("claims",))
def claims_by_confidence(t):
    return A.grouped(t.claims, "confidence")


@query("facet_values", """
    SELECT 'category' AS facet, value, count(*) AS n FROM (SELECT unnest(string_split(category, '|')) AS value FROM rec_people) GROUP BY value
    UNION ALL SELECT 'dossierStatus', coalesce(dossierStatus, 'Not recorded'), count(*) FROM rec_people GROUP BY 2
    UNION ALL SELECT 'evidenceBase', coalesce(evidenceBase, 'Not recorded'), count(*) FROM rec_people GROUP BY 2""", ("people",))
def facet_values(t):
    return A.facet_values(Snapshot(t)["people"], ["category", "dossierStatus", "evidenceBase"])


@query("facet_filter", """
    SELECT slug, name FROM rec_people WHERE list_contains(string_split(category, '|'), 'Diplomat') AND region = 'Rif' AND contains(lower(concat_ws(' ', name, oneLine)), 'moha')""", ("people",))
def facet_filter(t):
    people = Snapshot(t)["people"].withColumn("search", F.lower(F.concat_ws(" ", "name", "oneLine")))
    return A.facet_filter(people, {"category": "Diplomat", "region": "Rif", "dossierStatus": ""}, " MOHA ").select("slug", "name")


@query("front_page_figures", """
    SELECT 'resolved' AS name, count(*) FILTER (status = 'Resolved') AS n FROM rec_disputes UNION ALL SELECT 'live', count(*) FILTER (status IS DISTINCT FROM 'Resolved') FROM rec_disputes
    UNION ALL SELECT 'decisive', count(*) FILTER (priority = '1 - decisive') FROM rec_archives UNION ALL SELECT 'decisiveAtHome', count(*) FILTER (priority = '1 - decisive' AND country = 'Spain') FROM rec_archives
    UNION ALL SELECT 'unverified', count(*) FILTER (verification = 'NOT YET VERIFIED') FROM rec_archives UNION ALL SELECT 'withPlan', count(*) FILTER (notYetSearched IS NOT NULL) FROM rec_archives
    UNION ALL SELECT 'fullDossiers', count(*) FILTER (dossierStatus = 'Full dossier') FROM rec_people
    UNION ALL SELECT 'consulted', count(*) FILTER (trim(whatTheDocumentSays) <> '' AND NOT regexp_matches(whatTheDocumentSays, '(?i)^not (yet consulted|applicable)')) FROM rec_claims""",
       ("disputes", "archives", "people", "claims"))
def front_page_figures(t):
    return A.index_figures(t.disputes, t.archives, t.people, t.claims, "Spain")


@query("arabic_scholarship", f"""
    WITH a AS (SELECT slug, tier FROM rec_sources WHERE language = 'Arabic' AND tier IN ({S.listed(fixed.HOME_AUTHORED_TIERS)}))
    SELECT slug, tier, (SELECT count(*) FROM a) > 0 AS drifted FROM a""", ("sources",))
def arabic_scholarship(t):
    return A.home_authored(Snapshot(t)["sources"], "Arabic", fixed.HOME_AUTHORED_TIERS).select("slug", "tier", "drifted")


@query("people_order", f"""
    SELECT slug, row_number() OVER (ORDER BY coalesce({S.ladder('dossierStatus', fixed.DOSSIER_STATUS)}, -1), coalesce(CAST(nullif(regexp_extract(born, '\\b(1[0-9]{{3}}|20[0-9]{{2}})\\b', 1), '') AS INTEGER), 9999), name, slug) AS place
    FROM rec_people""", ("people",))
def people_order(t):
    """All people as the people list orders them."""
    from probatum.functions.text import derived_year
    return placed(t.people.withColumn("_derivedBornYear", derived_year(F.col("born"))), A.people_order()).select("slug", "place")


@query("source_order", f"""
    SELECT slug, row_number() OVER (ORDER BY coalesce({S.ladder('tier', fixed.TIERS)}, 8), title, slug) AS place FROM rec_sources""", ("sources",))
def source_order(t):
    return placed(t.sources, A.ladder_order("tier", fixed.TIERS, "title", "slug")).select("slug", "place")


@query("claim_order", f"""
    SELECT slug, row_number() OVER (ORDER BY coalesce({S.ladder('confidence', fixed.CLAIM_STATUSES)}, -1), slug, pos) AS place FROM rec_claims""", ("claims",))
def claim_order(t):
    return placed(t.claims, A.ladder_order("confidence", fixed.CLAIM_STATUSES, "slug", "pos", unknown_first=True)).select("slug", "place")
