import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probatum.functions import names as N
from probatum.functions.similarity import jaro_winkler


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


EQUAL = [("Māʾ al-ʿAynayn", "Ma al-Aynayn"), ("Muḥa u Ḥemmu Aẓayyi", "Muha u Hemmu Azayyi"), ("Mouha", "Muha"),
         ("Hammou", "Hammu"), ("Zaïani", "Zayani"), ("Jenífra", "Khénifra")]


def test_equal_match_keys(spark):
    keys = column(spark, [n for pair in EQUAL for n in pair], N.fold_key)
    assert keys[0::2] == keys[1::2]


def test_different_match_keys(spark):
    a, b = column(spark, ["Ainïn", "Aynayn"], N.fold_key)
    assert a != b


def test_particles_drop_unless_nothing_is_left(spark):
    assert column(spark, ["Sidi Mohamed ben Hammou", "Sidi ben", "Hammou des Zaïanes", ""], N.fold_key) == [
        "hamu mohamed", "ben sidi", "hamu saianes", ""]


def test_arabic_stays_in_its_script(spark):
    key, ordered = column(spark, ["مُحا  أو حمو"], N.fold_key) + column(spark, ["مُحا  أو حمو"], N.fold_ordered)
    assert ordered == "محا او حمو" and sorted(key.split()) == sorted(ordered.split())
    assert column(spark, ["محا", "Muha"], N.has_arabic) == [True, False]


def test_search_fold_is_idempotent_and_keeps_arabic(spark):
    values = ["Māʾ al-ʿAynayn", "ẒAYYI ı ß þ", "محا أو", "  Łódź "]
    once = column(spark, values, N.fold)
    assert once == ["ma al-aynayn", "zayyi i ss th", "محا أو", "lodz"]
    assert column(spark, once, N.fold) == once


def test_slugs(spark):
    assert column(spark, ["Casablanca 1907 — killings", "Ajdir · bay", "?!", "Muḥa's (house)"], N.slugify) == [
        "casablanca-1907-killings", "ajdir-bay", "untitled", "muha-s-house"]
    assert column(spark, ["ʿAyn ø"], lambda c: N.slugify(c, transliterate=False)) == ["ayn"]


def test_alias_lists(spark):
    field = "Fr. archives: 'Moha ou Hammou', 'le caïd Hammou', Hammou des Zaïanes · Tamazight: Muḥa · x · Zayani. Not to be confused with Y."
    assert column(spark, [field, None], N.split_aliases) == [
        ["Moha ou Hammou", "le caïd Hammou", "Hammou des Zaïanes", "Muḥa", "Zayani"], []]


def test_parsed_aliases_keep_tradition_script_and_notes(spark):
    raw = "Fr. archives: 'Moha', 'caïd, le' · محا · Name as supplied. Do not merge with him · Zaïani, Zayani"
    out = column(spark, [raw], N.parse_aliases)[0]
    assert [(a.value, a.tradition, a.script, a.isNote) for a in out] == [
        ("Moha", "Fr. archives", "latin", False), ("caïd, le", "Fr. archives", "latin", False), ("محا", "Ar", "arabic", False),
        ("Name as supplied. Do not merge with him", None, "latin", True), ("Zaïani, Zayani", None, "latin", False)]


def _by_definition(a, b):
    """Jaro-Winkler as the textbook gives it, quadratic."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = set(), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == x:
                used.add(j)
                left.append(x)
                break
    if not left:
        return 0.0
    right = [b[j] for j in sorted(used)]
    m, t = len(left), sum(x != y for x, y in zip(left, right))
    jaro = (m / len(a) + m / len(b) + (m - t / 2) / m) / 3
    prefix = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a[:4], b[:4]))))
    return jaro if jaro < 0.7 else jaro + prefix * 0.1 * (1 - jaro)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
def test_jaro_winkler_matches_its_definition(a, b):
    assert jaro_winkler(a, b) == pytest.approx(_by_definition(a, b))
