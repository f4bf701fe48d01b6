import pytest
from pyspark.sql import functions as F

from probatum.functions import clean as C
from probatum.functions import text as T


def one(spark, value, build, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(build(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,hit", [("lost 13,363.", True), ("lost 13,363 men", True), ("(13,363)", True), ("13363 dead", True),
                                      ("13,3635", False), ("13,363.5", False), ("2.13363", False)])
def test_a_number_stands_alone(spark, text, hit):
    assert one(spark, text, lambda v: F.regexp_like(v, F.lit(T.number_pattern([13363])))) is hit
    assert one(spark, text, lambda v: T.holds_number(v, F.lit("13,363"))) is hit


def test_positions_sentence_and_window(spark):
    text = "Ün 1; then 13,363 men. Next 13363\nlast 13,363"
    found = one(spark, text, lambda v: T.match_positions(v, T.number_pattern([13363])))
    assert [(m.start, m.hit) for m in found] == [(11, "13,363"), (28, "13363"), (39, "13,363")]
    assert all(text[m.start:].startswith(m.hit) for m in found)
    assert one(spark, text, lambda v: T.sentence_at(v, F.lit(11))).strip() == "then 13,363 men."
    assert one(spark, text, lambda v: T.sentence_at(v, F.lit(28))).strip() == "Next 13363"
    assert one(spark, text, lambda v: T.window_at(v, F.lit(11), 5)) == text[6:16].lower()


def test_ranges(spark):
    text = "from 7,875 to 13,363; 5 to 2; 1900–1910 and 4 and 9"
    assert [r.key for r in one(spark, text, T.ranges)] == ["7875-13363", "1900-1910", "4-9"]


def test_stripped_html_keeps_block_ends(spark):
    html = "<style>p{}</style><p>a&nbsp;b</p><div>c<br/>d <b>e</b></div><script>x</script>"
    assert one(spark, html, T.strip_tags).strip() == "a b\nc\nd e"


def test_plain_markdown(spark):
    assert one(spark, "**a** *b* `c`  [d](http://e)", T.plain) == "a b c d"


def test_components_go_their_children_stay(spark):
    body = "import A from 'a'\n\n\n\n<Range\n n={[1]}\n/>kept <Note>inner</Note>"
    assert one(spark, body, T.to_prose) == "kept inner"


def test_frontmatter(spark):
    raw = "---\ntitle: \"A: b\"\norder: 3\nskip me\n---\nbody"
    front, body = T.frontmatter_parts(F.col("v"))
    row = spark.createDataFrame([(raw,), ("no front",)], "v string").select(T.frontmatter_map(front), body).collect()
    assert row[0][0] == {"title": "A: b", "order": "3"} and row[0][1] == "body"
    assert row[1][0] == {} and row[1][1] == "no front"


@pytest.mark.parametrize("line,term,marked", [
    ('a "bandit" here', "bandit", True), ("a *bandit* here", "bandit", True), ("chief (bandit of", "bandit", True),
    ('he said "the bandit came" x', "bandit", True), ("`a bandit", "bandit", True), ("a bandit here", "bandit", False)])
def test_marked_terms(spark, line, term, marked):
    at = line.index(term)
    assert one(spark, line, lambda v: T.is_marked(v, F.lit(at), F.lit(len(term)))) is marked


def test_hedges_lost(spark):
    df = spark.createDataFrame([("about 300 men and up to 5", "300 men and up to 5"), ("c.300", "300"), ("c. 300", "300")], "a string, b string")
    assert [r[0] for r in df.select(T.hedges_lost(F.col("a"), F.col("b"))).collect()] == [["about"], ["c."], []]


def test_callouts_and_words_next_to_accents(spark):
    assert one(spark, "> **Terminology warning.** text", T.callout_kind) == "terminology"
    assert one(spark, "> **Other.** text", T.callout_kind) is None
    # an ASCII boundary lies between é and l
    assert one(spark, "élite", lambda v: F.regexp_like(v, F.lit(T.java_pattern(r"\blite\b")))) is True


def test_lists_from_text(spark):
    rows = {'["a", "b"]': ["a", "b"], "plain": ["plain"], "[broken": ["[broken"], "  ": [], None: [], "[1, 2]": ["1", "2"]}
    for value, want in rows.items():
        assert one(spark, value, C.text_list) == want


def test_small_cleaners(spark):
    assert one(spark, "  \n", C.text_or_null) is None
    assert one(spark, "https://x/A-" + "0f" * 16 + "?v=1", C.external_id) == "0f" * 16
    assert one(spark, "1836 (conventional). Some give 1857", T.derived_year) == 1836
    assert one(spark, "c. 11836", T.derived_year) is None
    assert one(spark, "Not yet consulted directly", C.has_verbatim) is False
    assert one(spark, "ARCHIVAL REFERENCE NOT YET VERIFIED. Carton 3", C.request_hint) == "Carton 3"
    assert one(spark, "ACADEMIC", C.tier_step) == 4 and one(spark, "RUMOUR", C.tier_step) is None
    assert one(spark, ["French civil", "Tribal leader"], C.narrative_position, "v array<string>") == "moroccan"
    assert [(f.value, f.position) for f in one(spark, [5, 1, 3], C.figure_range, "v array<int>")] == [(1, 0.0), (3, 0.5), (5, 1.0)]
    assert [f.position for f in one(spark, [4], C.figure_range, "v array<int>")] == [0.0]


def test_hash_keeps_nulls_and_ignores_volatile_fields(spark):
    df = spark.createDataFrame([("a", None, "1"), ("a", "", "1"), ("a", None, "2")], "x string, y string, hash string")
    hashes = [r[0] for r in df.select(C.content_hash(df)).collect()]
    assert hashes[0] == hashes[2] != hashes[1] and len(hashes[0]) == 16
