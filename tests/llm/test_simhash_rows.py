"""One row of each SimHash component, also where ids are repeated or null."""

from llm.helpers import frame
from probatum.llm import simhash


def test_repeated_and_null_ids(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey"
    rows = [(1, a, 0), (2, a, 1), (2, b, 2), (2, b, 3), (None, c, 4), (None, c.upper(), 5), (None, a, 6)]
    kept = simhash.one_of_each(frame(spark, rows, "doc_id bigint, text string, row int"))
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted((r.text.lower(), r.doc_id or 0) for r in kept.collect()) == sorted([(a, 1), (b, 2), (c, 0)])
