"""The pipeline against a brute-force version, stage by stage."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from llm.helpers import WORDS, frame
from llm.test_documents import plain_targets
from llm.test_resemblance import changed, plain_roots
from probatum.llm import repetition, tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: names that the operators use inside
MORE = ", row string, digest int, size int, key string"


def make(spark, folder):
    """Copies, near copies, repeated rows, null ids, texts and sources, a very long text."""
    draw = random.Random(8)
    rows = []
    for i in range(150):
        kind = draw.random()
        if rows and kind < 0.15:
            text = draw.choice(rows)[1]
        elif rows and kind < 0.4:
            text = changed(draw.choice(rows)[1], draw.choice([1, 1, 2, 8]), draw)
        else:
            text = " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) + draw.choice(["", ".\n"]) for _ in range(draw.randint(20, 90)))
        rows.append((i, text, "en", None if i % 7 == 0 else f"s{i % 3}", len(text)))
    whole = " ".join(f"{draw.choice(WORDS)}{draw.randrange(10 ** 6)}" for _ in range(30_000))
    rows += [(150, whole, "en", "s1", len(whole)), (151, changed(whole, 40, draw), "en", "s1", len(whole)), (152, None, None, "s1", 0), (153, "", "en", "s0", 0)]
    rows += [(None, changed(rows[3][1], 1, draw), "en", "s0", 9), (None, " ".join(f"n{i}" for i in range(30)), "en", "s0", 9), rows[4], rows[4]]
    frame(spark, [(*r, "x", 0, -1, None) for r in rows], SCHEMA + MORE).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return rows


def place(doc_id):
    return doc_id is None, doc_id or 0


def offset(source):
    return int(hashlib.md5(f"10:{source or ''}".encode()).hexdigest()[:8], 16) / 2 ** 32


def test_stages(spark, folder):
    rows = make(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "tokens"]
    rows = [r for r in rows if repetition.measure(r[1] or "")[-1]]
    last = {}
    for r in rows:
        if r[1] not in last or (r[0] is not None and (last[r[1]][0] is None or r[0] > last[r[1]][0])):
            last[r[1]] = r
    rows = list(last.values())
    groups = defaultdict(list)
    for i, root in plain_roots([r[1] for r in rows]).items():
        groups[root].append(rows[i])
    assert sum(len(g) > 1 for g in groups.values()) > 5  # near copies that no earlier stage has caught
    rows = [min(g, key=lambda r: place(r[0])) for g in groups.values()]
    sizes, by_source = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r[3]] += len(r[1].split())
        by_source[r[3]].append((len(r[1].split()), r[0]))
    targets, copies = plain_targets(dict(sizes)), Counter()
    for source, docs in by_source.items():
        each = targets[source] / sizes[source]
        for nth, (_, doc) in enumerate(sorted(docs, key=lambda d: (d[0], place(d[1]))), 1):
            copies[doc] = int(nth * each + offset(source)) - int((nth - 1) * each + offset(source))
    lib = tokens.tokenizer(tokens.vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1], add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())] += copies[r[0]]
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == +want


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_table(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), "")
    assert out.count() == 0
    assert name == "tokens" or out.columns == [f.split()[0] for f in SCHEMA.split(", ")]


def test_registered():
    import __spark_entry__ as entry
    from probatum.llm.queries import QUERIES
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
