from pyspark.sql import functions as F

from probatum.functions.names import parse_aliases
from probatum.operators import search as Q


def index(spark):
    rows = [("mhammad", "M'Hammad", "el hermano de Abd-el-Krim"), ("abdelkrim", "Mohammed ben Abdelkrim El Khattabi", "Abd el-Krim"),
            ("ayn", "Māʾ al-ʿAynayn", "ماء العينين"), ("hammou", "Sidi Ben Hammou", "Name as supplied. Do not merge with Zayani at all"),
            ("zayani", "Mouha ou Hammou Zayani", "Zaïani")]
    people = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, slug string, name string, aliasesRaw string")
    people = (people.withColumn("aliases", parse_aliases(F.col("aliasesRaw"))).withColumn("oneLine", F.lit(""))
              .withColumn("phase", F.array(F.lit("IV"))))
    return Q.build_index(people=people).join(people.select("slug", "ord"), "slug")


def best(spark, text):
    asked = spark.createDataFrame([(1, text)], "qid int, raw string")
    row = Q.best_match(index(spark), asked).first()
    return row and (row.slug, row.score)


def test_an_exact_alias_beats_a_fragment(spark):
    assert best(spark, "Abd el-Krim") == ("abdelkrim", 100)


def test_accents_fold_both_ways_and_arabic_matches_as_it_is(spark):
    assert best(spark, "Ma al-Aynayn") == ("ayn", 100)
    assert best(spark, "العينين") == ("ayn", 60)


def test_notes_are_no_names(spark):
    assert best(spark, "Zayani")[0] == "zayani"
    assert best(spark, "supplied") is None


def test_ranked_results_name_what_matched(spark):
    asked = spark.createDataFrame([(1, "zaiani"), (2, "hammou")], "qid int, raw string")
    rows = Q.ranked(index(spark), asked).orderBy("qid", "rank").collect()
    assert [(r.qid, r.slug, r.score, r.via) for r in rows] == [
        (1, "zayani", 100, "Zaïani"), (2, "zayani", 45, None), (2, "hammou", 45, None)]
    assert Q.ranked(index(spark), asked, types=["event"]).count() == 0
    assert Q.ranked(index(spark), asked, phase="IV", top=1).count() == 2


def test_terms_that_are_not_folded(spark):
    sources = spark.createDataFrame([("s", "Title", "Author", "SHD 3H")], "slug string, title string, author string, archivalReference string")
    row = Q.build_index(sources=sources).first()
    assert row.terms == ["Title", "Author", "SHD 3H"] and row.folded == ["title", "author"]


def test_few_queries_meet_the_terms_where_they_are_and_score_as_many_do(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "zaiani"), (2, "hammou"), (3, "Abd el-Krim"), (4, "العينين"), (5, " "), (6, "M'Ham"), (7, "Zaïani")], "qid int, raw string")
    scores = lambda: sorted(map(tuple, Q.score_records(index(spark), asked).collect()))
    looked_up, lookups = Q.containment_pairs, []
    monkeypatch.setattr(Q, "containment_pairs", lambda *a: lookups.append(a) or looked_up(*a))
    few = scores()
    assert few and not lookups
    monkeypatch.setattr(Q, "FEW", 3)
    assert scores() == few and lookups
