"""Blocked ranking against a plain score of every pair."""

import math
import re
from collections import Counter

import numpy as np

from llm.helpers import documents, nothing
from probatum.llm import tile_rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, rank int, row int"


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 50 + 50 * c.total() * n_docs // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(plain_terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def case(spark, folder):
    rows, docs = documents(spark, 90, folder)
    items = [(i, rows[20 + i][1], 0, 0) for i in range(12)] + [(50, "The RIVER stone", 1, 1), (50, "The RIVER stone", 1, 1), (None, "märz 12", 0, 0),
                                                                  (51, None, 0, 0), (52, " .. ", 0, 0), (53, "nowhere", 0, 0), (54, "long the", 0, 0)]
    return [(r[0], r[1]) for r in rows], docs, [(i, t) for i, t, *_ in items], spark.createDataFrame(items, ITEMS)


def test_against_every_pair(spark, folder):
    plain_docs, docs, plain_items, items = case(spark, folder)
    for top in (3, 50):
        got = tile_rank.rank(docs, items, top=top)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(plain_docs, plain_items, top)


def test_small_tiles_and_blocks(spark, folder, monkeypatch):
    plain_docs, docs, plain_items, items = case(spark, folder)
    for name, value in (("BLOCK_BYTES", 1500), ("TILE_ITEMS", 3), ("TILE_TERMS", 5), ("TILE_DOCS", 7)):
        monkeypatch.setattr(tile_rank, name, value)
    assert sorted(map(tuple, tile_rank.rank(docs, items, top=4).collect()), key=str) == plain(plain_docs, plain_items, 4)


def test_sums_of_a_tile_stay_exact():
    weight = np.full(6, 2 ** 31, dtype=np.int64)
    parts = tile_rank.tiles([np.arange(6), np.array([2])], weight)
    assert [len(p.weights) for p in parts[0]] == [4, 2]  # 4 * 2^31 * 10^6 < 2^53 < 5 * 2^31 * 10^6
    assert sum(p.weights[:, 0].sum() for p in parts[0]) == 6 * 2 ** 31


def test_best_keeps_ties_by_id():
    best = tile_rank.Best(1, 3)
    for ids in ([9, 4, 7, 8], [3, 6], [5, 1, 2, 0, 10]):
        best.add(np.array([0]), np.full((len(ids), 1), 5), np.array(ids), np.zeros(len(ids), dtype=np.int64))
    assert best.held[3].tolist() == [0, 1, 2]


def test_empty_tables(spark, folder):
    _, docs, _, items = case(spark, folder)
    assert tile_rank.rank(nothing(spark), items).collect() == []
    assert tile_rank.rank(docs, items.limit(0)).collect() == []
