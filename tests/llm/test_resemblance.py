"""Links of similar texts against all pairs, and the near-dedup stage."""

import itertools
import random
from collections import defaultdict

import numpy as np

import corpus_pipeline
from llm.helpers import frame
from llm.test_documents import plain_classes, plain_fingerprint
from probatum.llm import components, resemblance, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_shingles(text: str | None) -> set:
    words = (text or "").lower().split()
    k = max(1, min(5, len(words)))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def plain_roots(texts: list[str | None]) -> dict[int, int]:
    sets, roots = [plain_shingles(t) for t in texts], {}
    for i in range(len(texts)):
        if i not in roots:
            todo, roots[i] = [i], i
            while todo:
                a = sets[todo.pop()]
                for b in range(len(texts)):
                    if b not in roots and 5 * len(a & sets[b]) >= 4 * len(a | sets[b]):
                        roots[b] = i
                        todo.append(b)
    return roots


def changed(text: str, n: int, draw: random.Random) -> str:
    words = text.split()
    for at in draw.sample(range(len(words)), n):
        words[at] = f"new{draw.randrange(10 ** 6)}"
    return " ".join(words)


def texts(draw: random.Random) -> list[str | None]:
    """Single texts, near copies at both sides of the limit, a group too large for full buckets, a passage in many texts."""
    def fresh(n):
        return " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    out = [None, "", "One", "one", "one two", fresh(4)]
    for n in (25, 60, 100, 400):
        for _ in range(4):
            base = fresh(n)
            out += [base, base.upper().replace(" ", " \n"), changed(base, 1, draw), changed(base, 2, draw), changed(base, max(2, n // 40), draw)]
    base, passage = fresh(90), fresh(30)
    group = [base]
    for _ in range(60):  # some are a link away from one another, some only by way of others
        group.append(changed(draw.choice(group), draw.choice([1, 1, 2, 3]), draw))
    out += group + [f"{passage} {fresh(5)}" for _ in range(40)] + [f"{passage} {fresh(60)}" for _ in range(40)]
    draw.shuffle(out)
    return out


def test_links_are_all_pairs(spark):
    listed = texts(random.Random(4))
    edges = resemblance.links(frame(spark, list(enumerate(listed)), "row bigint, text string").repartition(3))
    found = edges.collect()
    sets = [plain_shingles(t) for t in listed]
    assert all(5 * len(sets[r.u] & sets[r.v]) >= 4 * len(sets[r.u] | sets[r.v]) for r in found)
    roots = {r.u: r.root for r in components.components(edges).collect()}
    assert {i: roots.get(i, i) for i in range(len(listed))} == plain_roots(listed)


def test_stage_drops_near_copies(spark):
    draw = random.Random(6)
    rows = []
    for i in range(0, 60, 3):
        base = " ".join(f"w{draw.randrange(5000)}" for _ in range(80))
        rows += [(i + k, t, "en", "s", len(t)) for k, t in enumerate([base, changed(base, 1, draw), changed(base, 20, draw)])]
    prints = plain_classes({r[0]: plain_fingerprint(r[1]) for r in rows})
    assert sum(prints[i] != i for i in prints) < 5  # two bits of three-word shingles leave most of them
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows, SCHEMA), "")
    assert sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] % 3 != 1]


def test_one_row_of_each(spark):
    draw = random.Random(7)
    a, b = (" ".join(f"{p}{draw.randrange(5000)}" for _ in range(50)) for p in "ab")
    rows = [(2, a, 0), (1, a + " end", 1), (1, b, 2), (1, b, 3), (None, b + " end", 4), (None, "c", 5), (None, "C", 6), (3, None, 7), (4, " ", 8)]
    kept = resemblance.one_of_each(frame(spark, rows, "doc_id bigint, text string, row int")).collect()
    by_component = defaultdict(list)
    for r in kept:
        by_component[{0: "a", 1: "a", 2: "b", 3: "b", 4: "b", 5: "c", 6: "c", 7: "", 8: ""}[r.row]].append(r.doc_id)
    assert by_component == {"a": [1], "b": [1], "c": [None], "": [3]}


def test_passage_in_many_texts_takes_no_square(spark):
    """Texts of a common passage and a few words of their own share a shingle, and none of them is compared."""
    draw = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(5))) for i in range(6000)]
    assert resemblance.links(frame(spark, rows, "row bigint, text string")).count() == 0


def test_parities_never_tell_similar_sets_apart():
    draw = np.random.default_rng(3)
    for n in (40, 900, 1500, 30_000):
        a = draw.integers(1 << 63, size=n, dtype=np.uint64)
        b = np.concatenate([a[n // 10:], draw.integers(1 << 63, size=n // 10, dtype=np.uint64)])
        words = 8 if n <= resemblance.LONG_FROM else 8 + resemblance.LONG_BITS // 64
        p, q = resemblance.parity(np.unique(a)), resemblance.parity(np.unique(b))
        assert len(p) == len(q) == words
        for part in (slice(0, 8), slice(8, None)):
            apart = sum((x ^ y).bit_count() for x, y in zip(p[part].view("<u8").tolist(), q[part].view("<u8").tolist()))
            assert apart <= 2 * (n // 10)


def test_near_dedup_takes_pairs_by_simhash_first_and_loses_no_link(spark, monkeypatch):
    draw, asked = random.Random(12), []
    base = " ".join(f"w{draw.randrange(5000)}" for _ in range(600))
    # within 2 bits or not, alike or not
    rows = [base, base.replace(" ", "  ", 3), base.upper(), changed(base, 1, draw), changed(base, 12, draw), changed(base, 200, draw), "", " ", *texts(draw)[:60]]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(rows)], SCHEMA)
    whole = simhash.near_rows

    def near(table):
        asked.append({(r.u, r.v) for r in whole(table).collect()})
        return whole(table)
    monkeypatch.setattr(simhash, "near_rows", near)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(plain_roots(rows).values()))
    numbered = frame(spark, list(enumerate(rows)), "row bigint, text string")
    pairs, fp = {(r.u, r.v) for r in whole(numbered).collect()}, [plain_fingerprint(t or "") for t in rows]
    assert len(asked) == 1 and asked[0] and all(v < u and (fp[u] ^ fp[v]).bit_count() <= 2 for u, v in pairs)
    edges = frame(spark, sorted(pairs), "u bigint, v bigint")
    roots = {r.u: r.root for r in components.components(edges).collect()}
    for u in range(len(rows)):
        assert all(roots.get(u, u) == roots.get(v, v) for v in range(u) if (fp[u] ^ fp[v]).bit_count() <= 2)


def test_members_of_large_buckets_are_written_without_parities(spark, monkeypatch):
    """A text is a member of many buckets; its parities would be written with each."""
    seen, plain = {}, resemblance.written

    def noted(df, name, *more):
        seen.setdefault(name, set()).update(df.columns)
        return plain(df, name, *more)
    monkeypatch.setattr(resemblance, "written", noted)
    passages = [" ".join(f"{p}{i}" for i in range(8)) for p in "abcdef"]
    rows = [(i, " ".join(order)) for i, order in enumerate(itertools.permutations(passages, 5))]
    texts = spark.createDataFrame(rows, "row bigint, text string")
    resemblance.links(texts).collect()
    assert "open" in seen and not {n for n, columns in seen.items() if "key" in columns and "parities" in columns}


def test_a_graph_of_one_chunk_needs_no_rounds(spark, monkeypatch):
    steps, plain = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name, *more: (steps.append(name), plain(df, name, *more))[1])
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 200)] + [(500, 300), (300, 400), (7, 7)], "u bigint, v bigint").repartition(5)
    want = {i: 0 for i in range(1, 200)} | {400: 300, 500: 300}
    assert {r.u: r.root for r in components.components(edges).collect()} == want
    assert len(steps) == 2
    assert {r.u: r.root for r in components.components(edges, chunk=20).collect()} == want
    assert components.components(edges.where("u < 0")).collect() == []
