"""The chosen-path join against all pairs."""

import random

import numpy as np
import pytest

from llm.helpers import documents, frame, nothing
from llm.test_resemblance import changed
from probatum.llm import chosen_path

SCHEMA = "doc_id bigint, text string, row string, n int"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def plain(rows):
    sets, out = [plain_set(t) for _, t in rows], [None] * len(rows)
    for i in range(len(rows)):
        if out[i] is None:
            todo, found = [i], {i}
            while sets[i] and todo:
                a = sets[todo.pop()]
                for b in range(len(rows)):
                    if b not in found and sets[b] and 100 * len(a & sets[b]) >= 80 * len(a | sets[b]):
                        found.add(b)
                        todo.append(b)
            ids = [rows[j][0] for j in found if rows[j][0] is not None]
            for j in found:
                root = (min(ids) if ids else None) if sets[j] else rows[j][0]
                out[j] = (rows[j][0], len(sets[j]), root, rows[j][0] is not None and rows[j][0] == root)
    return sorted(out, key=str)


def texts(draw):
    fresh = lambda n: " ".join(f"w{draw.randrange(4000)}" for _ in range(n))
    out = [None, "", " \n", "One", "one", "one two", "ONE  TWO", "Été", "été", "two one"]
    for n in (12, 25, 60, 100, 400, 3000):
        for _ in range(4):
            base = fresh(n)
            out += [base, base.upper(), changed(base, 1, draw), changed(base, max(1, n // 22), draw), changed(base, max(2, n // 16), draw)]
    base, passage = fresh(90), fresh(30)
    group = [base]
    for _ in range(150):
        group.append(changed(draw.choice(group), draw.choice([1, 1, 2, 3]), draw))
    out += group + [f"{passage} {fresh(5)}" for _ in range(60)] + [f"{passage} {fresh(60)}" for _ in range(40)]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("small,block,depth", [(64, 256, 5), (8, 16, 2)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, small, block, depth):
    for name, value in (("SMALL", small), ("BLOCK", block), ("DEPTH", depth)):
        monkeypatch.setattr(chosen_path, name, value)
    rows = list(enumerate(texts(random.Random(small))))
    got = chosen_path.similar_documents(frame(spark, rows, "doc_id bigint, text string").repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_odd_rows(spark, folder):
    rows, docs = documents(spark, 60, folder)
    rows = [(r[0], r[1]) for r in rows]
    assert sorted(map(tuple, chosen_path.similar_documents(docs.withColumnRenamed("size", "row").withColumnRenamed("digest", "node")).collect()), key=str) == plain(rows)
    assert chosen_path.similar_documents(nothing(spark)).collect() == []
    rows = [(None, "a b c", "", 0), (None, "A b c", "", 0), (4, "d e f", "", 1), (4, "d e f", "", 1), (None, None, "", 2)]
    assert sorted(map(tuple, chosen_path.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain([r[:2] for r in rows])


def test_sketches_keep_similar_sets():
    draw = np.random.default_rng(4)
    least = chosen_path.POSITIONS
    for n in (20, 100, 1000):
        for _ in range(150):
            both = draw.integers(1 << 63, size=n, dtype=np.uint64)
            own = draw.integers(1 << 63, size=n // 4, dtype=np.uint64)  # similarity 0.8
            a, b = chosen_path.minwise(np.concatenate([both, own[::2]])), chosen_path.minwise(np.concatenate([both, own[1::2]]))
            least = min(least, int((a.astype(np.uint8) == b.astype(np.uint8)).sum()))
    assert least >= chosen_path.AGREE


def test_parities_drop_only_sets_below_the_similarity():
    draw = np.random.default_rng(5)
    rejected = kept = 0
    for n, own in [(90, 10), (900, 100), (9000, 1000), (90, 20), (300, 60)]:  # members of both, and of each alone
        for _ in range(30):
            every = np.unique(draw.integers(1 << 63, size=n + 2 * own, dtype=np.uint64))
            every = draw.permutation(every)
            sets = [np.sort(np.concatenate([every[:n], every[n + k * own:n + (k + 1) * own]])) for k in (0, 1)]
            sketch = np.frombuffer(b"".join(chosen_path.minwise(h).astype(np.uint8).tobytes() + chosen_path.parity(h) for h in sets), dtype=np.uint8).reshape(2, -1)
            near, _ = chosen_path._near(np.array([len(h) for h in sets]), sketch, np.array([0]), np.array([1]))
            if chosen_path.alike(*sets):
                kept += 1
                assert near[0]
            else:
                rejected += not near[0]
    assert kept == 90 and rejected >= 50


def test_members_of_a_larger_node_meet_several_of_them(spark):
    """One member that is like few others would leave the node open at every level."""
    n = chosen_path.SMALL + 20
    texts = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(200)) + f" x{i}") for i in range(n)], "row bigint, text string")
    about = chosen_path._marked(texts).select("row", "n", "sketch")
    nodes = about.selectExpr("1L AS node", "row", "n", "row AS root", f"{n}L AS size")
    pairs = {(r.u, r.v) for r in chosen_path._stars(nodes, about).collect()}
    assert len(pairs) == sum(n - 1 - k for k in range(chosen_path.PIVOTS))
    joined = nodes.selectExpr("node", "row", "n", "0L AS root", "size")
    assert chosen_path._stars(joined, about).collect() == []


def test_tables_are_planned_by_what_they_take_in_memory(spark, folder, monkeypatch):
    """A compressed table of row numbers is no small table: the driver puts its broadcast together."""
    from probatum.operators.scale import planned_bytes

    n, seen = 300_000, {}
    spark.range(n).selectExpr("id AS row", "id % 1000 AS root").coalesce(1).write.parquet(f"{folder}/rows")
    by_files = planned_bytes(spark.read.parquet(f"{folder}/rows"))

    def linked(sets, texts):
        seen["bytes"] = planned_bytes(spark.read.parquet(f"{folder}/rows"))
        raise RuntimeError("seen")

    monkeypatch.setattr(chosen_path, "linked", linked)
    with pytest.raises(RuntimeError, match="seen"):
        chosen_path.similar_documents(frame(spark, [(1, "a b c")], "doc_id bigint, text string"))
    assert by_files < 16 * n < seen["bytes"]
    assert planned_bytes(spark.read.parquet(f"{folder}/rows")) == by_files
