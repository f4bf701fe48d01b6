import random

from pyspark.sql import functions as F

from probatum.operators import scale
from probatum.operators.scale import contained_somewhere, containment_pairs, list_pages, lookup_join, ordinal_within


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_salted_join_equals_the_plain_one(spark):
    # one key holds a third of the rows
    left = spark.range(900).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        salted = lookup_join(left, right, ["k"], how, limit=0, hot_rows=100, salts=4)
        assert sorted(map(str, rows(salted))) == sorted(map(str, rows(left.join(right, ["k"], how))))
        assert "_salt" not in salted.columns


def test_small_right_sides_are_broadcast(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    plan = lookup_join(spark.range(10).withColumnRenamed("id", "k"), small, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_ordinals_of_a_hot_key(spark):
    data = [("hot" if i % 3 else f"k{i % 7}", i * 3) for i in range(500)] + [(None, 4), (None, 5)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k string, ord long")
    got = {(r.k, r.ord): r.ordinal for r in ordinal_within(df, ["k"], "ord").collect()}
    want = {}
    for k in {d[0] for d in data}:
        for n, (_, o) in enumerate(sorted(d for d in data if d[0] == k), start=1):
            want[k, o] = n
    assert got == want


def test_ordinals_of_one_row(spark):
    df = spark.createDataFrame([("a", 5)], "k string, ord long")
    assert [tuple(r) for r in ordinal_within(df, ["k"], "ord").collect()] == [("a", 5, 1)]


def test_list_pages_keep_every_member_in_order(spark):
    df = spark.range(25).select(F.lit("a").alias("k"), "id", F.col("id").cast("string").alias("v"))
    pages = list_pages(df, ["k"], "id", "v", page_size=10).orderBy("page").collect()
    assert [len(p["items"]) for p in pages] == [10, 10, 5]
    assert [v for p in pages for v in p["items"]] == [str(i) for i in range(25)]


def test_containment_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 12)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(120)]
    patterns = {t[a:a + n].strip() for t in texts[:60] for a in (0, 2, 5) for n in (1, 3, 9, 14)} - {""} | {"zz", "ab zz"}
    t = spark.createDataFrame(list(enumerate(texts)), "tid int, text string")
    p = spark.createDataFrame([(x,) for x in sorted(patterns)], "p string")
    want = sorted((x, i) for x in patterns for i, text in enumerate(texts) if x in text)
    assert rows(containment_pairs(p, t, "p", "p", "tid", "text")) == want
    assert [r[0] for r in rows(contained_somewhere(p, t, "p", "p", "tid", "text"))] == sorted({x for x, _ in want})


def test_containment_is_that_of_all_pairs(spark, monkeypatch):
    draw = random.Random(5)
    words = ["a", "ab", "abc", "bcd", "river", "riverbank", "the", "of", "x" * 12, "x" * 9 + "yz", "é", "12"]
    some = lambda n, gap: gap.join(draw.choice(words) for _ in range(n))
    patterns = [some(draw.randint(1, 5), draw.choice([" ", " ", "  ", "\n"])) for _ in range(150)] + ["river bank", "b r", " the", "the ", " ", "", None, "zzz", "the zzz of"]
    patterns += [p[1:] for p in patterns[:40]] + [p[:-1] for p in patterns[:40]]
    texts = [some(draw.randint(1, 25), " ") for _ in range(80)] + [patterns[3] + "!", "(" + patterns[7], None, ""]
    p = spark.createDataFrame(list(enumerate(patterns)), "p int, pattern string")
    t = spark.createDataFrame(list(enumerate(texts)), "t int, body string")
    want = sorted((i, j) for i, x in enumerate(patterns) for j, y in enumerate(texts) if x and x.split() and y and x in y)
    for frequent in (1000, 10, 0):
        monkeypatch.setattr(scale, "FREQUENT", frequent)
        assert rows(containment_pairs(p, t, "p", "pattern", "t", "body")) == want
        assert rows(contained_somewhere(p, t, "p", "pattern", "t", "body")) == sorted({(i,) for i, _ in want})


def test_patterns_on_a_common_word_meet_few_texts(spark):
    """1,000 patterns share a word that half the texts hold."""
    patterns = spark.range(1000).select(F.col("id").alias("p"), F.concat(F.lit("see the n"), F.col("id") * 7 % 1000, F.lit(" the report the end")).alias("pattern"))
    body = F.when(F.col("id") % 2 == 0, F.concat(F.lit("we see the n"), F.col("id") % 3000, F.lit(" the report the end of it"))).otherwise(F.lit("nothing here"))
    texts = spark.range(6000).select(F.col("id").alias("t"), body.alias("body"))
    anchored, hits, words = scale._lookup(patterns, texts, "p", "pattern", "t", "body")
    assert scale.containment_candidates(anchored, hits, words).count() == 1000 == containment_pairs(patterns, texts, "p", "pattern", "t", "body").count()
    # all words of these are common: both anchors count
    pairs = spark.range(1000).select(F.col("id").alias("p"), F.concat(F.lit("the a"), F.col("id") % 4, F.lit(" b"), F.floor(F.col("id") / 4) % 4, F.lit(" end")).alias("pattern"))
    texts = spark.range(40_000).select(F.col("id").alias("t"), F.concat(F.lit("in the a"), F.col("id") % 5, F.lit(" b"), F.floor(F.col("id") / 5) % 5, F.lit(" end")).alias("body"))
    anchored, hits, words = scale._lookup(pairs, texts, "p", "pattern", "t", "body")
    assert anchored.where("second IS NULL").count() == 0
    found = containment_pairs(pairs, texts, "p", "pattern", "t", "body").count()
    assert scale.containment_candidates(anchored, hits, words).count() == found == 1000 * 40_000 // 25


def test_pairs_of_two_hot_sides_are_dealt_out(spark):
    from probatum.operators.scale import paired
    left = spark.range(3000).selectExpr("id AS l", "CASE WHEN id < 2900 THEN 'hot' ELSE CONCAT('k', id) END AS key")
    right = spark.range(300).selectExpr("id AS r", "CASE WHEN id < 200 THEN 'hot' ELSE CONCAT('k', id + 2700) END AS key", "CAST(NULL AS STRING) AS none")
    found = paired(left, right, ["key"])
    assert found.columns == ["l", "key", "r", "none"]
    rows = found.selectExpr("count(*) AS n", "count(DISTINCT l, r) AS d").first()
    assert (rows.n, rows.d) == (2900 * 200 + 100, 2900 * 200 + 100)


def test_pairs_are_made_in_as_many_tasks_as_shuffles_have(spark):
    """The lists are small, the pairs are not: the few bytes of a shuffle must not be merged into one task."""
    from probatum.operators.scale import paired
    left, right = (spark.range(0, 500, 1, 3).selectExpr(f"id AS {c}", "CASE WHEN id >= 0 THEN 'hot' END AS key") for c in "lr")
    found = paired(left, right, ["key"])
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
    assert found.count() == 500 * 500


def test_held_sources_state_a_pair_once(spark):
    from probatum.operators.contain import held_sources
    archives = spark.createDataFrame([("a1", "House of Fez (x)"), ("a2", "House of Fez"), ("a3", "House"), ("a3", "House of Fez"), ("a4", None)],
                                     "slug string, institution string")
    sources = spark.createDataFrame([("s1", "kept in the House of Fez", "house of fez, box 2"), ("s2", None, "The House"), ("s3", None, None)],
                                    "slug string, archivalReference string, publisher string")
    found = held_sources(archives, sources)
    assert sorted(map(tuple, found.collect())) == [("a1", "s1"), ("a2", "s1"), ("a3", "s1"), ("a3", "s2")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the pairs of archives with one name are made last: no aggregate stands above their join
    assert not plan.lstrip().startswith("Aggregate")


def test_hot_keys_are_counted_by_key_only_in_full_groups(spark):
    from probatum.operators.scale import lookup_join
    left = spark.range(4000).selectExpr("CASE WHEN id < 3000 THEN 'hot' ELSE CONCAT('k', id) END AS key", "id AS n")
    right = spark.range(4000).selectExpr("CASE WHEN id = 0 THEN 'hot' ELSE CONCAT('k', id) END AS key", "id AS v")
    joined = lookup_join(left, right, ["key"], limit=0, hot_rows=1000)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, "key", "left").collect()))
    # rows of all keys are counted by hashed groups only
    assert "_bucket" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_references_of_several_lists_in_one_pass(spark):
    from probatum.operators import graph, resolve
    ids = ["0123456789abcdef0123456789abcdef", "0123456789ABCDEF0123456789ABCDEF", "x", "", "ü" * 16]
    records = spark.createDataFrame([("c1", ids[:3], [ids[3]]), ("c2", None, [ids[4], None]), ("c3", [], [ids[0], "lost"])],
                                    "slug string, people array<string>, archives array<string>")
    index = spark.createDataFrame([(i, f"s{n}", "people", f"n{n}") for n, i in enumerate(ids)], "id string, slug string, collection string, name string")
    refs = resolve.reference_lists(records, {"people": "people", "archives": "archives"}, as_address=False)
    one_by_one = resolve.reference_rows(records, "people", "people", as_address=False).unionByName(
        resolve.reference_rows(records, "archives", "archives", as_address=False))
    assert sorted(map(tuple, refs.collect())) == sorted(map(tuple, one_by_one.collect()))
    found = resolve.resolve_references(refs, index)
    assert sorted((r.owner, r.label, r.pos, r.id, r.slug or "") for r in found.collect()) == sorted(
        (r.owner, r.label, r.pos, r.id, f"s{ids.index(r.id)}" if r.id in ids else "") for r in refs.collect())
    edges = graph.claim_edges(resolve.links(found))
    assert edges.columns == ["source", "target", "kind", "relation", "strength", "id"]
    assert {(r.source, r.target, r.id) for r in edges.where("target = 'claim:c1' OR source = 'claim:c1'").collect()} == {
        ("person:s0", "claim:c1", "s0--c1"), ("person:s1", "claim:c1", "s1--c1"), ("person:s2", "claim:c1", "s2--c1"), ("claim:c1", "archive:s3", "c1--s3")}
    # the links are read once, not once for each kind of edge
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
