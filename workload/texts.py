"""Text functions over documents, pages and names."""

from pyspark.sql import functions as F

from probatum import fixed
from probatum.functions import names as N
from probatum.functions import text as T
from probatum.operators import rules, tallies
from probatum.operators.claims import resolve_lead_in
from probatum.sources.documents import assemble
from workload import sqltext as S
from workload.records import quoted
from workload.registry import query


@query("search_keys", f"""
    SELECT doc_id, md5({S.search_fold('text')}) AS folded FROM documents""")
def search_keys(t):
    return t.documents.select("doc_id", F.md5(N.fold(F.col("text"))).alias("folded"))


@query("match_keys", f"""
    WITH b AS (SELECT slug, name FROM rec_people UNION ALL SELECT slug, aliasesRaw FROM rec_people),
         n AS (SELECT slug, name, {S.match_fold('name')} AS f FROM b)
    SELECT slug, array_to_string({S.fold_tokens('name', 'f')}, ' ') AS key, {S.fold_ordered('name', 'f')} AS ordered,
           {S.arabic('name')} AS arabic FROM n""", ("people",))
def match_keys(t):
    n = F.col("name")
    both = t.people.select("slug", "name").unionByName(t.people.select("slug", F.col("aliasesRaw").alias("name")))
    return both.select("slug", N.fold_key(n).alias("key"), N.fold_ordered(n).alias("ordered"), N.has_arabic(n).alias("arabic"))


@query("document_match_keys", f"""
    WITH n AS (SELECT doc_id, text, {S.match_fold('text')} AS f FROM documents)
    SELECT doc_id, md5(array_to_string({S.fold_tokens('text', 'f')}, ' ')) AS key FROM n""")
def document_match_keys(t):
    return t.documents.select("doc_id", F.md5(N.fold_key(F.col("text"))).alias("key"))


@query("alias_spellings", f"""
    WITH s AS (SELECT slug, aliasesRaw, ord % 4 AS k, 'Customer#' || lpad(CAST(ord AS STRING), 9, '0') AS c FROM rec_people WHERE aliasesRaw IS NOT NULL)
    SELECT slug, unnest(CASE k WHEN 0 THEN ['Moha ou Hammou', 'le caïd ' || c, 'des Zaïanes', 'Muḥa']
                               WHEN 1 THEN ['Mohammed Sellam Ameziane', c]
                               WHEN 2 THEN ['Name as supplied here by one. Do not merge ' || c] ELSE ['محا أو حمو ' || c] END) AS spelling FROM s""", ("people",))
def alias_spellings(t):
    return t.people.select("slug", F.explode(N.split_aliases(F.col("aliasesRaw"))).alias("spelling"))


@query("alias_records", f"""
    WITH s AS (SELECT slug, ord % 4 AS k, 'Customer#' || lpad(CAST(ord AS STRING), 9, '0') AS c FROM rec_people),
         v AS (SELECT slug, unnest(CASE k WHEN 0 THEN ['Moha ou Hammou', 'le caïd ' || c, 'des Zaïanes', 'Muḥa']
                               WHEN 1 THEN ['Mohammed Sellam Ameziane', c]
                               WHEN 2 THEN ['Name as supplied here by one. Do not merge ' || c] ELSE ['محا أو حمو ' || c] END) AS value,
                      unnest(CASE k WHEN 0 THEN ['Fr. archives', 'Fr. archives', 'Fr. archives', 'Tamazight']
                               WHEN 1 THEN [NULL, NULL] WHEN 2 THEN [NULL] ELSE ['Ar'] END) AS tradition FROM s)
    SELECT slug, value, tradition, CASE WHEN value LIKE 'محا%' THEN 'arabic' ELSE 'latin' END AS script, {S.search_fold('value')} AS folded, value LIKE 'Name as%' AS is_note FROM v""",
       ("people",))
def alias_records(t):
    rows = t.people.select("slug", F.explode(N.parse_aliases(F.col("aliasesRaw"))).alias("a"))
    return rows.select("slug", "a.value", "a.tradition", "a.script", "a.folded", F.col("a.isNote").alias("is_note"))


@query("plain_bodies", f"""
    WITH a AS (SELECT slug, regexp_replace(body, '`([^`]*)`', '\\1', 'g') AS b FROM rec_bodies),
         c AS (SELECT slug, regexp_replace(b, '\\*\\*([^*]*)\\*\\*', '\\1', 'g') AS b FROM a),
         d AS (SELECT slug, regexp_replace(b, '\\*([^*]*)\\*', '\\1', 'g') AS b FROM c),
         e AS (SELECT slug, regexp_replace(b, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') AS b FROM d)
    SELECT slug, md5({S.squeeze('b')}) AS plain FROM e""", ("bodies",))
def plain_bodies(t):
    return t.bodies.select("slug", F.md5(T.plain(F.col("body"))).alias("plain"))


_BLOCK = fixed.BLOCK_END
@query("page_texts", f"""
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<script[\\s\\S]*?</script>', ' ', 'g'), '(?i)<style[\\s\\S]*?</style>', ' ', 'g') AS h FROM pages),
         b AS (SELECT page_id, regexp_replace(h, '(?i){_BLOCK}', chr(10), 'g') AS h FROM a),
         c AS (SELECT page_id, regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '(?i)&[a-z]+;', ' ', 'g') AS h FROM b),
         d AS (SELECT page_id, regexp_replace(regexp_replace(h, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g') AS h FROM c)
    SELECT page_id, md5(regexp_replace(h, '\\n{{2,}}', chr(10), 'g')) AS text FROM d""")
def page_texts(t):
    return t.pages.select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("text"))


@query("lead_ins", f"""
    WITH l AS (SELECT o_orderkey, CASE o_orderkey % 8 {' '.join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(
        ['Established.', 'HIGHLY PROBABLE:', 'withheld rather than unknown', 'Alleged and unproven', 'Status', 'Nothing', 'Contested:', 'Unreliable on']))} END AS lead FROM orders),
         k AS (SELECT o_orderkey, lower(regexp_replace(lead, '[.:]$', '')) AS k FROM l),
         m(k, canonical, status, withheld) AS (VALUES {', '.join(f"({quoted(a.lower())}, {quoted(a)}, {quoted(b)}, {str(c).lower()})" for a, b, c in fixed.LEAD_INS)})
    SELECT o_orderkey, canonical, status, withheld FROM k LEFT JOIN m USING (k)""")
def lead_ins(t):
    values = ["Established.", "HIGHLY PROBABLE:", "withheld rather than unknown", "Alleged and unproven", "Status", "Nothing", "Contested:", "Unreliable on"]
    lead = F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return t.orders.select("o_orderkey", resolve_lead_in(lead).alias("r")).select("o_orderkey", "r.canonical", "r.status", "r.withheld")


@query("marker_tokens", f"""
    SELECT slug, regexp_matches(body, '(?i)' || {quoted('|'.join(f'(?:{p})' for p in fixed.WITHHELD_PATTERNS))}) AS withheld,
           array_to_string(list_filter([{S.listed(fixed.TIERS)}], lambda x: contains(body, x)), ';') AS tiers,
           array_to_string(list_filter([{S.listed(fixed.VERIFICATION_TOKENS)}], lambda x: contains(body, x)), ';') AS verification FROM rec_bodies""", ("bodies",))
def marker_tokens(t):
    b = F.col("body")
    return t.bodies.select("slug", T.looks_withheld(b).alias("withheld"), F.array_join(T.tokens_present(b, fixed.TIERS), ";").alias("tiers"),
                           F.array_join(T.tokens_present(b, fixed.VERIFICATION_TOKENS), ";").alias("verification"))


@query("callouts", """
    WITH l AS (SELECT slug, unnest(string_split(body, chr(10))) AS line FROM rec_bodies),
         o AS (SELECT slug, trim(regexp_extract(line, '^\\s*>\\s*\\*\\*([^*]*)\\*\\*', 1)) AS opener FROM l)
    SELECT slug, opener, CASE WHEN opener LIKE 'Terminology%' THEN 'terminology' ELSE 'evidence' END AS kind FROM o
    WHERE opener IN (""" + S.listed(fixed.CALLOUT_OPENERS) + ")", ("bodies",))
def callouts(t):
    lines = t.bodies.select("slug", F.explode(F.split("body", "\n")).alias("line")).where(T.is_blockquote(F.col("line")))
    opener = T.strip(F.regexp_extract("line", r"^\s*>\s*\*\*([^*]*)\*\*", 1))
    return lines.select("slug", opener.alias("opener"), T.callout_kind(F.col("line")).alias("kind")).where("kind IS NOT NULL")


@query("written_ranges", """
    WITH p AS (SELECT slug, regexp_extract_all(oneLine, '([0-9][0-9,]*)\\s*(?:[–—-]|to|and)\\s*([0-9][0-9,]*)', 1) AS lo,
                      regexp_extract_all(oneLine, '([0-9][0-9,]*)\\s*(?:[–—-]|to|and)\\s*([0-9][0-9,]*)', 2) AS hi FROM rec_people),
         u AS (SELECT slug, unnest(lo) AS low, unnest(hi) AS high FROM p)
    SELECT slug, low, high, replace(low, ',', '') || '-' || replace(high, ',', '') AS key FROM u
    WHERE CAST(replace(high, ',', '') AS DOUBLE) > CAST(replace(low, ',', '') AS DOUBLE)""", ("people",))
def written_ranges(t):
    return t.people.select("slug", F.inline(T.ranges(F.col("oneLine"))))


@query("filing_terms", f"""
    WITH d(term, language, issuer) AS (VALUES {', '.join('(' + S.listed(r) + ')' for r in fixed.TERM_DICTIONARY)}),
         w AS (SELECT slug, trim(regexp_extract(lower(body), '\\b(dissident|rebelle|bandit|cheval)\\b', 1)) AS asked FROM rec_bodies)
    SELECT slug, asked, language, issuer FROM w JOIN d ON lower(d.term) = asked WHERE asked <> ''""", ("bodies",))
def filing_terms(t):
    return rules.filed_terms(_asked_terms(t), fixed.TERM_DICTIONARY)[0].select("slug", "asked", "language", "issuer")


def _asked_terms(t, words=r"\b(dissident|rebelle|bandit|cheval)\b"):
    asked = F.regexp_extract(F.lower("body"), T.java_pattern(words), 1)
    return t.bodies.select("slug", asked.alias("asked")).where("asked <> ''")


@query("unknown_terms", f"""
    WITH w AS (SELECT slug, regexp_extract(lower(body), '\\b(dissident|rebelle|bandit|the)\\b', 1) AS asked FROM rec_bodies)
    SELECT DISTINCT 'unknown-term' AS rule, 'error' AS severity, slug, 'The dictionary lacks "' || asked || '"' AS message FROM w
    WHERE asked <> '' AND asked NOT IN ({', '.join("lower('" + t[0] + "')" for t in fixed.TERM_DICTIONARY)})""", ("bodies",))
def unknown_terms(t):
    return rules.filed_terms(_asked_terms(t, r"\b(dissident|rebelle|bandit|the)\b"), fixed.TERM_DICTIONARY)[1].select("rule", "severity", "slug", "message")


@query("contents_lists", """
    WITH l AS (SELECT slug, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS n FROM rec_bodies),
         f AS (SELECT *, coalesce(sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences FROM l)
    SELECT slug, CAST(n AS INTEGER) AS line_no, CAST(length(regexp_extract(line, '^(#{2,3})\\s+(.*)$', 1)) AS INTEGER) AS depth, trim(regexp_extract(line, '^(#{2,3})\\s+(.*)$', 2)) AS title
    FROM f WHERE fences % 2 = 0 AND regexp_matches(line, '^#{2,3}\\s+')""", ("bodies",))
def contents_lists(t):
    return tallies.headings(t.bodies)


@query("transcripts", """
    SELECT conv_id, 0 AS page, md5(string_agg(CASE role WHEN 'user' THEN '## ' || text ELSE '> ' || text END, chr(10) || chr(10) ORDER BY turn)) AS body
    FROM conversations GROUP BY conv_id""")
def transcripts(t):
    from probatum.sources.documents import render_block
    kind = F.when(F.col("role") == "user", "heading_2").otherwise("quote")
    out = assemble(t.conversations, ["conv_id"], "turn", render_block(kind, F.col("text")))
    return out.select("conv_id", F.col("page").cast("int").alias("page"), F.md5("body").alias("body"))


@query("document_prose", """
    SELECT slug, md5(body) AS body, 'Title ' || ord AS title, source AS origin FROM rec_bodies""", ("bodies",))
def document_prose(t):
    """Frontmatter put on and taken off again."""
    raw = F.concat(F.lit('---\ntitle: "Title '), F.col("ord").cast("string"), F.lit('"\norigin: '), "source", F.lit("\n---\n"), "body")
    front, body = T.frontmatter_parts(raw)
    fields = T.frontmatter_map(front)
    return t.bodies.select("slug", F.md5(body).alias("body"), F.element_at(fields, "title").alias("title"), F.element_at(fields, "origin").alias("origin"))


@query("component_prose", f"""
    WITH a AS (SELECT slug, CASE WHEN ord % 2 = 0 THEN {S.strip("chr(10) || body || 'kept'")} ELSE {S.strip('body')} END AS b FROM rec_bodies)
    SELECT slug, md5({S.strip("regexp_replace(b, '\\n{3,}', chr(10) || chr(10), 'g')")}) AS body FROM a""", ("bodies",))
def component_prose(t):
    wrapped = F.concat(F.lit("import X from 'y'\n"), "body", F.lit('<Range\n n={1}\n/><Note kind="a">kept</Note>'))
    return t.bodies.select("slug", F.md5(T.to_prose(F.when(F.col("ord") % 2 == 0, wrapped).otherwise(F.col("body")))).alias("body"))
