"""Record cleaning: lists, ids, slugs, hashes, dates and display fields."""

from pyspark.sql import functions as F

from probatum import fixed
from probatum.functions import clean
from probatum.functions.names import country_slug, short_institution, slugify, surname
from probatum.functions.text import derived_year, truncate
from probatum.operators.resolve import with_unique_slug
from probatum.sources.collections import rank_snapshots
from probatum.sources.properties import from_view, read_property
from workload import sqltext as S
from workload.registry import query


@query("list_fields", f"""
    WITH raw AS (SELECT slug, CASE ord % 5 WHEN 0 THEN '["' || replace(category, '|', '", "') || '"]'
                   WHEN 1 THEN '[broken' WHEN 2 THEN '  ' WHEN 3 THEN category ELSE NULL END AS v FROM rec_people)
    SELECT slug, CASE WHEN v IS NULL OR trim(v) = '' THEN '' WHEN v LIKE '[%]' THEN array_to_string(json_extract_string(v, '$[*]'), ';')
                      ELSE trim(v) END AS items FROM raw""", ("people",))
def list_fields(t):
    quoted = F.concat(F.lit('["'), F.replace("category", F.lit("|"), F.lit('", "')), F.lit('"]'))
    kind = F.col("ord") % 5
    raw = (F.when(kind == 0, quoted).when(kind == 1, "[broken").when(kind == 2, "  ").when(kind == 3, F.col("category")))
    return t.people.select("slug", F.array_join(clean.text_list(raw), ";").alias("items"))


@query("derived_years", f"""
    SELECT slug, born, CAST(nullif(regexp_extract(born, '\\b(1[0-9]{{3}}|20[0-9]{{2}})\\b', 1), '') AS INTEGER) AS year
    FROM rec_people""", ("people",))
def derived_years(t):
    return t.people.select("slug", "born", derived_year(F.col("born")).alias("year"))


@query("external_ids", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE md5('person' || CAST(c_custkey AS STRING)) END AS id FROM customer""")
def external_ids(t):
    h = F.md5(F.concat(F.lit("person"), F.col("c_custkey").cast("string")))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    kind = F.col("c_custkey") % 3
    url = F.when(kind == 0, F.concat(F.lit("https://x/Name-"), h, F.lit("?v=1"))).when(
        kind == 1, F.concat(F.lit("https://x/"), dashed)).otherwise(F.lit("https://x/none"))
    return t.customer.select("c_custkey", clean.external_id(url).alias("id"))


@query("slugs", f"""
    WITH f AS (SELECT slug AS key, {S.search_fold('name')} AS a, lower({S.no_accents('name')}) AS b FROM rec_people
               UNION ALL SELECT slug, {S.search_fold('institution')}, lower({S.no_accents('institution')}) FROM rec_archives)
    SELECT key, {S.slugify('a')} AS site, {S.slugify('b')} AS audit FROM f""", ("people", "archives"))
def slugs(t):
    names = t.people.select(F.col("slug").alias("key"), F.col("name").alias("n")).unionByName(
        t.archives.select(F.col("slug").alias("key"), F.col("institution").alias("n")))
    return names.select("key", slugify(F.col("n")).alias("site"), slugify(F.col("n"), transliterate=False).alias("audit"))


@query("unique_slugs", f"""
    WITH b AS (SELECT p_partkey, {S.slugify('lower(p_name)')} AS base FROM part),
         n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b)
    SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM n""")
def unique_slugs(t):
    return with_unique_slug(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "slug")


@query("narrative_positions", """
    WITH c AS (SELECT slug, string_split(category, '|') AS c FROM rec_people)
    SELECT slug, CASE """ + " ".join(
    f"WHEN list_has_any(c, [{S.listed(m)}]) THEN '{label}'" for label, m in fixed.NARRATIVE_POSITIONS)
       + " ELSE 'other' END AS position FROM c", ("people",))
def narrative_positions(t):
    return t.people.select("slug", clean.narrative_position(F.split("category", "[|]")).alias("position"))


@query("content_hashes", """
    WITH g AS (SELECT p_name, p_type, p_size, count(*) AS n FROM part GROUP BY ALL)
    SELECT n, count(*) AS records FROM g GROUP BY n""")
def content_hashes(t):
    records = t.part.select("p_name", "p_type", "p_size")
    sizes = records.groupBy(clean.content_hash(records).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("n").agg(F.count(F.lit(1)).alias("records"))


@query("event_dates", """
    SELECT slug, substring(start, 1, 4) AS year, strftime(TRY_CAST(start AS DATE), '%-d %B %Y') AS shown FROM rec_incidents""",
       ("incidents",))
def event_dates(t):
    return t.incidents.select("slug", clean.year_of(F.col("start")).alias("year"), clean.long_date(F.col("start")).alias("shown"))


@query("archive_lines", f"""
    SELECT slug, trim(regexp_replace(institution, '\\s*\\(.*\\)\\s*$', '')) AS short,
           CASE WHEN city IS NULL THEN country WHEN country IS NULL THEN city ELSE city || ' — ' || country END AS place,
           trim(regexp_replace(lower(country), '[^a-z0-9]+', '-', 'g'), '-') AS country_slug,
           CASE WHEN notYetSearched IS NULL THEN 'Not yet documented' ELSE 'Written' END AS backlog,
           lower(concat_ws(' ', institution, city, notYetSearched)) AS blob FROM rec_archives""", ("archives",))
def archive_lines(t):
    return t.archives.select(
        "slug", short_institution(F.col("institution")).alias("short"),
        clean.place_line(F.col("city"), F.col("country")).alias("place"), country_slug(F.col("country")).alias("country_slug"),
        clean.backlog_flag(F.col("notYetSearched")).alias("backlog"),
        clean.search_blob("institution", "city", "notYetSearched").alias("blob"))


@query("claim_quotations", f"""
    WITH c AS (SELECT slug, coalesce({S.strip('whatTheDocumentSays')}, '') AS w, archivalReference AS r FROM rec_claims)
    SELECT slug, (w <> '' AND NOT regexp_matches(w, '(?i)^not (yet consulted|applicable)')) AS verbatim,
           nullif(trim(regexp_replace(r, '^ARCHIVAL REFERENCE NOT YET VERIFIED[. ]*', '')), '') AS hint FROM c""", ("claims",))
def claim_quotations(t):
    return t.claims.select("slug", clean.has_verbatim(F.col("whatTheDocumentSays")).alias("verbatim"),
                           clean.request_hint(F.col("archivalReference")).alias("hint"))


@query("dispute_positions", """
    SELECT slug, concat_ws(';', 'french=' || french, 'spanish=' || spanish, 'moroccan=' || moroccan, 'other=' || other) AS held,
           concat_ws(';', CASE WHEN french IS NULL THEN 'french' END, CASE WHEN spanish IS NULL THEN 'spanish' END,
                     CASE WHEN moroccan IS NULL THEN 'moroccan' END, CASE WHEN other IS NULL THEN 'other' END) AS silent
    FROM rec_disputes""", ("disputes",))
def dispute_positions(t):
    d = t.disputes.withColumn("positions", F.struct("french", "spanish", "moroccan", "other"))
    held = F.transform(clean.held_positions(F.col("positions")), lambda p: F.concat_ws("=", p["party"], p["text"]))
    return d.select("slug", F.array_join(held, ";").alias("held"),
                    F.array_join(clean.silent_positions(F.col("positions")), ";").alias("silent"))


@query("figure_positions", """
    WITH v AS (SELECT doc_id, unnest([n_chars, n_chars % 97, n_chars % 13]) AS v FROM documents),
         s AS (SELECT doc_id, v, min(v) OVER (PARTITION BY doc_id) AS lo, max(v) OVER (PARTITION BY doc_id) AS hi,
                      row_number() OVER (PARTITION BY doc_id ORDER BY v) - 1 AS i FROM v)
    SELECT doc_id, CAST(i AS INTEGER) AS i, v AS value, (v - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) AS position FROM s""")
def figure_positions(t):
    values = F.array(F.col("n_chars"), F.col("n_chars") % 97, F.col("n_chars") % 13)
    return t.documents.select("doc_id", F.posexplode(clean.figure_range(values)).alias("i", "f")).select(
        "doc_id", "i", "f.value", "f.position")


@query("people_labels", """
    SELECT slug, CASE WHEN length(regexp_extract(name, '(\\S+)$', 1)) >= 4 THEN regexp_extract(name, '(\\S+)$', 1) END AS surname,
           CASE WHEN length(oneLine) > 20 THEN substring(oneLine, 1, 20) || '…' ELSE oneLine END AS line FROM rec_people""", ("people",))
def people_labels(t):
    last = surname(F.col("name"))
    return t.people.select("slug", F.when(F.length(last) >= 4, last).alias("surname"), truncate(F.col("oneLine"), 20).alias("line"))


@query("source_tiers", f"""
    SELECT slug, tier, {S.ladder('tier', fixed.TIERS)} + 1 AS step FROM rec_sources""", ("sources",))
def source_tiers(t):
    step = clean.tier_step(F.col("tier"))
    return t.sources.select("slug", "tier", step.alias("step"))


@query("property_values", """
    WITH p AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, ts FROM events)
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(k AS STRING) WHEN 1 THEN event_type || ' ' || k WHEN 2 THEN event_type
             WHEN 4 THEN CAST(CAST(ts AS DATE) AS STRING) WHEN 5 THEN CASE WHEN k > 50 THEN 'true' ELSE 'false' END END AS text,
           CASE event_id % 8 WHEN 3 THEN event_type || ';' || k WHEN 6 THEN 'u' || user_id END AS items FROM p""")
def property_values(t):
    k = F.get_json_object("props", "$.k")
    name = lambda v: F.struct(v.alias("name"))
    run = lambda v: F.struct(v.alias("plain_text"))
    kind = F.col("event_id") % 8
    prop = (F.when(kind == 0, F.to_json(F.struct(F.lit("number").alias("type"), k.cast("double").alias("number"))))
            .when(kind == 1, F.to_json(F.struct(F.lit("title").alias("type"), F.array(run(F.concat("event_type", F.lit(" "))), run(k)).alias("title"))))
            .when(kind == 2, F.to_json(F.struct(F.lit("select").alias("type"), name(F.col("event_type")).alias("select"))))
            .when(kind == 3, F.to_json(F.struct(F.lit("multi_select").alias("type"), F.array(name(F.col("event_type")), name(k)).alias("multi_select"))))
            .when(kind == 4, F.to_json(F.struct(F.lit("date").alias("type"), F.struct(F.to_date("ts").cast("string").alias("start")).alias("date"))))
            .when(kind == 5, F.to_json(F.struct(F.lit("checkbox").alias("type"), (k.cast("int") > 50).alias("checkbox"))))
            .when(kind == 6, F.to_json(F.struct(F.lit("relation").alias("type"), F.array(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"))).alias("relation"))))
            .otherwise(F.to_json(F.struct(F.lit("formula").alias("type"), k.alias("x")))))
    value = read_property(prop)
    return t.events.select("event_id", value["text"].alias("text"), F.array_join(value["items"], ";").alias("items"))


@query("view_rows", """
    SELECT o_orderkey, array_to_string(['P' || o_custkey, o_orderstatus], ';') AS people, '' AS tags,
           CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS note,
           CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS start FROM orders""")
def view_rows(t):
    rows = t.orders.select(
        "o_orderkey", F.to_json(F.array(F.concat(F.lit("P"), F.col("o_custkey").cast("string")), F.col("o_orderstatus"))).alias("people"),
        F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("note"),
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.to_date("o_orderdate").cast("string")).alias("date:When:start"))
    out = from_view(rows, arrays=("people", "tags"), dates={"When": "start"})
    return out.withColumn("people", F.array_join("people", ";")).withColumn("tags", F.array_join("tags", ";"))


@query("snapshot_ages", """
    WITH d AS (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS STRING) AS snapshot_date FROM orders)
    SELECT snapshot_date, CAST(row_number() OVER (ORDER BY snapshot_date DESC) AS INTEGER) AS age FROM d""")
def snapshot_ages(t):
    return rank_snapshots(t.orders.select(F.to_date("o_orderdate").cast("string").alias("snapshot_date")).distinct())
