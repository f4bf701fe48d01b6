"""Exact dedup, mixing, repetition rules, SimHash and licenses against plain versions."""

import hashlib
import math
import re
import uuid
from collections import Counter, defaultdict

import pytest
import xxhash

from llm.helpers import documents, frame, nothing
from probatum.llm import components, exact_dedup, licenses, mixing, repetition, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def index(spark, name=None):
    return exact_dedup.DigestIndex(spark, name or f"t_{uuid.uuid4().hex}", 3)


# ------------------------------------------------------------------ exact dedup
def test_exact_dedup(spark):
    rows, docs = documents(spark)
    got = index(spark).add(docs).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(rows)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[text] if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(groups[text]))
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_first_copies(docs, index(spark))
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(groups)


def test_index_persists(spark):
    name = f"t_{uuid.uuid4().hex}"
    first = frame(spark, [(1, "a"), (2, "b"), (5, "a")], "doc_id bigint, text string")
    index(spark, name).add(first).collect()
    again = {r.doc_id: r for r in index(spark, name).add(first).collect()}
    assert {i: r.kept for i, r in again.items()} == {1: False, 2: True, 5: True}
    later = {r.doc_id: r for r in index(spark, name).add(frame(spark, [(9, "a"), (10, "c"), (11, "c")], "doc_id bigint, text string")).collect()}
    assert [(later[i].keep_id, later[i].kept) for i in (9, 10, 11)] == [(5, False), (11, False), (11, True)]
    assert index(spark, name).table().count() == 3
    assert index(spark, name).add(nothing(spark)).count() == 0


# ------------------------------------------------------------------ mixing
def plain_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target, full = share * sum(sizes.values()), {}, set()
    while True:
        rest = sum(weight[s] for s in order if s not in full)
        left = budget - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    rows, docs = documents(spark, 120)
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = plain_targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    assert mixing.mix(nothing(spark)).count() == 0 and mixing.mixed_rows(nothing(spark)).count() == 0


def test_mix_of_empty_texts(spark):
    docs = frame(spark, [(1, "", "a"), (2, None, "b")], "doc_id bigint, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0.0, 0)] * 2


# ------------------------------------------------------------------ repetition
def plain_measures(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated), failed


def test_repetition(spark):
    rows, docs = documents(spark, 80)
    got = repetition.measured(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == plain_measures(r.text)
        assert not (q.base_failed and q.kept)
    kept = repetition.passing(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.quality.kept for r in got)
    assert repetition.measured(nothing(spark)).count() == 0


def test_repeated_characters():
    words = [f"w{i:03}" for i in range(60)]
    assert repetition.measure(" ".join(words))[-1]
    line = " ".join(words[:10])
    measures = repetition.measure("\n".join([line, line, *[" ".join(words[i:i + 10]) for i in range(10, 60, 10)]]))
    assert math.isclose(measures[6], 10 / 70) and math.isclose(measures[8], (40 + 9) / 280)
    assert not repetition.measure("\n".join([line, line, line, *[" ".join(words[i:i + 10]) for i in range(10, 60, 10)]]))[-1]


# ------------------------------------------------------------------ SimHash
def plain_fingerprint(text: str | None) -> int:
    words = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    words = [w for w in words if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks():
    masks = simhash.covering_masks()
    for i in range(64):
        for j in range(i + 1):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def plain_classes(prints: dict[int, int]) -> dict[int, int]:
    """Smallest id reachable over links of 2 bits or fewer."""
    out = {}
    for i in sorted(prints):
        if i not in out:
            todo, out[i] = [i], i
            while todo:
                a = todo.pop()
                for b in prints:
                    if b not in out and (prints[a] ^ prints[b]).bit_count() <= 2:
                        out[b] = i
                        todo.append(b)
    return out


def test_near_duplicates(spark):
    rows, docs = documents(spark, 90)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows if r[0] is not None}
    want = plain_classes(prints)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | {None}
    assert simhash.near_duplicates(nothing(spark)).count() == 0


def test_large_buckets(spark):
    """A group whose members fill one bucket: flips of few bits of one value, and strangers."""
    import random
    draw = random.Random(5)
    base = draw.getrandbits(64)
    values = {base} | {base ^ (1 << a) ^ (1 << b) for a in range(9) for b in range(a)} | {draw.getrandbits(64) for _ in range(60)}
    values |= {base ^ sum(1 << draw.randrange(64) for _ in range(4)) for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(frame(spark, [(v,) for v in signed], "fp bigint"))
    roots = {r.u: r.root for r in components.components(edges).collect()}
    got, want = defaultdict(set), plain_classes({v: v & ((1 << 64) - 1) for v in signed})
    for v in signed:
        got[roots.get(v, v)].add(v)
    classes = defaultdict(set)
    for v, c in want.items():
        classes[c].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


@pytest.mark.parametrize("edges,want", [([], {}), ([(3, 1), (2, 3), (9, 8)], {3: 1, 2: 1, 9: 8}),
                                        ([(i, i + 1) for i in range(40)], {i: 0 for i in range(1, 41)})])
def test_components(spark, edges, want):
    assert {r.u: r.root for r in components.components(frame(spark, edges, "u bigint, v bigint")).collect()} == want


# ------------------------------------------------------------------ licenses
def plain_places(text: str | None) -> dict[str, list[int]]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    out = {"": [len(words)]}
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        out[label] = [i for i in range(len(words)) if words[i:i + len(p)] == p]
    return out


def test_licenses(spark):
    mit = licenses.TEMPLATES[10][1]
    rows = [(1, None), (2, ""), (3, "Licensed under CC BY-NC 4.0. cc by cc by"), (4, "All rights reserved, all rights reserved."),
            (5, "x " * 500 + mit.upper() + " tail"), (6, "x " + " ".join(mit.split()[:12] + ["very"] + mit.split()[12:])),
            (7, " ".join(mit.split()[:14])), (8, "the GNU General Public License, version 3"), (9, "cc"), (10, "general public é license"),
            (None, "cc by"), (11, "cc by"), (11, "cc by"), (12, "cc " * 20_000 + "by")]
    docs = frame(spark, [(i, t, 5, "z") for i, t in rows], "doc_id bigint, text string, pos int, label string")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text in rows:
        places, r = plain_places(text), by_id[i]
        starts = sorted(p for label, at in places.items() if label for p in at)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (places[""][0], len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(label for label, at in places.items() if label and at))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert by_id[3].labels == "cc-by,cc-by-nc" and by_id[5].labels == by_id[6].labels == "mit" and by_id[7].labels == ""
    assert by_id[5].score == 1 and by_id[7].score == 0
    assert licenses.scan(frame(spark, [], "doc_id bigint, text string")).count() == 0
