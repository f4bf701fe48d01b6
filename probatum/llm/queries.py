"""The queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm import (bpe, chosen_path, exact_dedup, licenses, mixing, nbsvm, orchard, ppm, repetition, simhash, tile_rank,
                          token_files, warc)
from probatum.llm.shared import scope

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build
    return add


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def bpe_digests(encoded: DataFrame) -> DataFrame:
    """Digests of ids and decoded texts."""
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_partial_matching")
def op1(spark: SparkSession, root: str) -> DataFrame:
    return ppm.score(_table(spark, root, "documents"))


@query("op2_repetition_rules")
def op2(spark: SparkSession, root: str) -> DataFrame:
    docs = repetition.measured(_table(spark, root, "documents").select("doc_id", "text"))
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    more = ["top_gram_share", "repeated_gram_share", "repeated_line_share", "repeated_line_chars"]
    return docs.select("doc_id", *[F.col(f"quality.{c}") for c in first + more])


@query("op3_warc_index_merge", """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
         ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM hashed
""")
def op3(spark: SparkSession, root: str) -> DataFrame:
    archive = warc.Archive.write(_table(spark, root, "pages"))
    return archive.read().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_diagonal_licenses")
def op4(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan(_table(spark, root, "documents"))


@query("op5_naive_bayes_svm")
def op5(spark: SparkSession, root: str) -> DataFrame:
    return nbsvm.classify(_table(spark, root, "documents"), _table(spark, root, "labels"))


@query("op6_distinct_word_bpe")
def op6(spark: SparkSession, root: str) -> DataFrame:
    return bpe_digests(bpe.encode(_table(spark, root, "documents")))


@query("op7_covering_simhash")
def op7(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, root, "documents"))


@query("op8_token_files")
def op8(spark: SparkSession, root: str) -> DataFrame:
    files = token_files.TokenFiles.write(_table(spark, root, "documents"))
    return files.read().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_digest_index", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op9(spark: SparkSession, root: str) -> DataFrame:
    with scope(spark) as tables:
        index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", lasting=False)
        told = index.add(_table(spark, root, "documents"))
        tables.keep(told)
    return told


@query("op10_systematic_mix", """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM totals),
filled AS (  -- sources reach their limit in order of size over weight
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS nth,
         coalesce(sum(2.0::DOUBLE * source_size) OVER earlier, 0) AS held,
         (SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER earlier, 0) AS rest
  FROM weighed WINDOW earlier AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT min_by(per_weight, nth) AS per_weight FROM (
    SELECT nth, weight, source_size, (1.5::DOUBLE * (SELECT sum(source_size) FROM totals) - held) / rest AS per_weight FROM filled)
  WHERE per_weight * weight < 2.0::DOUBLE * source_size),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * per_weight) AS target,
         ('0x' || substr(md5('10:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM weighed, level),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) AS place FROM sized)
SELECT p.doc_id, p.size::BIGINT AS size, t.source_size, t.target,
       ((floor(p.place * (t.target / t.source_size) + start) - floor((p.place - 1) * (t.target / t.source_size) + start))
        * p.size)::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
""")
def op10(spark: SparkSession, root: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, root, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _rounds() -> str:
    """Ten rounds of exact clustering, one after the other."""
    parts = []
    for i in range(orchard.ROUNDS + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i})
  GROUP BY vec_id)""")
        if i < orchard.ROUNDS:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS x FROM (
      SELECT best.c AS c, pos, sum(v[pos]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(pos) GROUP BY ALL) GROUP BY c) m
  ON m.c = c{i}.c)""")
    return ",".join(parts)


@query("op11_orchard_clusters", f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR))::INT - 1 AS c, v AS x FROM kept
  ORDER BY sha256('3:' || vec_id::VARCHAR) LIMIT 8),{_rounds()}
SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM a{orchard.ROUNDS} JOIN c{orchard.ROUNDS} ON best.c = c{orchard.ROUNDS}.c
""")
def op11(spark: SparkSession, root: str) -> DataFrame:
    return orchard.cluster(_table(spark, root, "embeddings"))


@query("op12_chosen_paths", """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM worded),
classes AS MATERIALIZED (  -- equal sets once
  SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS shingle FROM classes),
links AS MATERIALIZED (
  SELECT a.id AS u, b.id AS v FROM items a JOIN items b ON a.shingle = b.shingle AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
sides AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (
  SELECT id AS u, id AS root FROM classes
  UNION
  SELECT sides.v, reached.root FROM reached JOIN sides ON sides.u = reached.u WHERE reached.root < sides.v),
roots AS (SELECT u, min(root) AS root FROM reached GROUP BY u)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(root, sets.doc_id) AS component_id, sets.doc_id = coalesce(root, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN roots ON roots.u = classes.id
""")
def op12(spark: SparkSession, root: str) -> DataFrame:
    return chosen_path.similar_documents(_table(spark, root, "documents"))


@query("op13_blocked_ranking", """
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counted AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM sizes),
lengths AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // l AS m FROM sizes, whole),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
""")
def op13(spark: SparkSession, root: str) -> DataFrame:
    return tile_rank.rank(_table(spark, root, "documents"), _table(spark, root, "benchmark"))
