"""Token files, BPE, partial matching and the classifier against the library and plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import documents, frame, nothing
from probatum.llm import bpe, nbsvm, packs, ppm, token_files, tokens
from probatum.llm.queries import bpe_digests


def library(name):
    return tokens.tokenizer(tokens.vocabulary(name))


# ------------------------------------------------------------------ words
@pytest.mark.parametrize("name,splitter", [("byte_bpe_50k.json", tokens.byte_splitter), ("word_bpe_49k.json", tokens.plain_splitter)])
def test_words_give_the_library_ids(name, splitter):
    cut = splitter(tokens.vocabulary(name))
    odd = ["", "   x\n\n y  ", "it's we'll 'twas ''s", "Ünïcödé ½ Ⅷ ² x²", "a b c\x1dd", "é ẞ İ ΣΑΣ σς", "日本語 한국어 🙂🙂 🏳️‍🌈",
           "<|endoftext|>", "a<|endoftext|> b <|startoftext|>", "_x_ __ -- 1.5e3 007", "\t\n", "١٢ १"]
    for text in odd:
        want = library(name).encode(text, add_special_tokens=False).ids
        assert [i for ids in cut.encode(cut.words(text)) for i in ids] == want, text


def test_runs_between_white_space_are_cut_once_and_give_the_library_ids(monkeypatch):
    cut, lib, calls = tokens.plain_splitter(tokens.vocabulary("word_bpe_49k.json")), library("word_bpe_49k.json"), Counter()
    whole = cut.words_of
    monkeypatch.setattr(cut, "words_of", lambda run: calls.update([run]) or whole(run))
    odd = ["", "  ", "(don't) --'s x_y 12½ ÀÉ", "Ab ab, ab. (ab) " * 50, "<|ENDOFTEXT|> a", "x <|endoftext|> y", "ΑΣ abc's Σ", "e\u0301 a\x1cb \x00", "İ ẞ 日本語 🙂"]
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in odd]
    ids = tokens.WordIds(cut, "<u2")
    assert ids.packed(odd) == want and ids.packed(odd) == want
    assert calls["ab,"] == calls["(ab)"] == 1 and max(calls.values()) == 1
    assert tokens.WordIds(cut, "<u2", most=4).packed(odd + odd) == want + want


# ------------------------------------------------------------------ BPE
@pytest.mark.parametrize("from_files", [True, False])
def test_bpe(spark, folder, from_files):
    rows, docs = documents(spark, 50, folder if from_files else None)
    encoded = bpe.encode(docs)
    got = encoded.collect()
    assert len(got) == len(rows) and encoded.columns == ["doc_id", "ids", "decoded"]
    lib, want = library("byte_bpe_50k.json"), defaultdict(list)
    for r in rows:
        want[r[0]].append(lib.encode(r[1] or "", add_special_tokens=False).ids)
    for r in got:
        assert list(r.ids) in want[r.doc_id]
        assert r.decoded == lib.decode(list(r.ids), skip_special_tokens=False)
    one = bpe_digests(encoded).where("doc_id = 20").first()
    assert one.ids_sha256 == hashlib.sha256(",".join(map(str, want[20][0])).encode()).hexdigest()
    assert bpe.encode(nothing(spark)).count() == 0


def test_small_packs(spark, folder):
    _, docs = documents(spark, 40, folder)
    packed = packs.with_packs(docs.select("doc_id", "text"), pack_bytes=5000)
    assert packed.select("pack").distinct().count() > 3
    assert packed.count() == docs.count()


# ------------------------------------------------------------------ token files
def test_token_files(spark):
    rows, docs = documents(spark, 50)
    files = token_files.TokenFiles.write(docs)
    got = sorted(files.read().collect(), key=lambda r: r.start)
    lib = library("word_bpe_49k.json")
    want = Counter((r[0], (*lib.encode(r[1] or "", add_special_tokens=False).ids, 2)) for r in rows)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids) // 4)
        start += r.n_tokens
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and got[-1].doc_id is None
    name = files.files.first()["file"]
    source = token_files.TokenFile(files.folder, name)  # finds its dictionary by hash
    assert source.ids(1)[-1] == token_files.END_ID
    with pytest.raises(ValueError):
        token_files.TokenFile(files.folder, name, b"another")
    empty = token_files.TokenFiles.write(nothing(spark))
    assert empty.files.count() == 0 and empty.read().count() == 0


# ------------------------------------------------------------------ partial matching
class Trie:
    """Contexts of up to ``order`` bytes; shorter ones count a symbol once per longer context it was new in."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            data = bytes([ppm.START]) * order + ppm.text_bytes(t) + bytes([ppm.END])
            for at in range(order, len(data)):
                self.counts[order][data[at - order:at]][data[at]] += 1
        for k in range(order - 1, -1, -1):
            for context, symbols in self.counts[k + 1].items():
                for s in symbols:
                    self.counts[k][context[1:]][s] += 1

    def log10(self, context, symbol):
        total, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            all_here = self.counts[k].get(context[self.order - k:], {})
            here = {s: c for s, c in all_here.items() if s not in excluded}
            if here:
                whole = sum(here.values())
                if symbol in here:
                    return total + math.log10((here[symbol] - ppm.GIVEN) / whole)
                total += math.log10(ppm.GIVEN * len(here) / whole)
            excluded |= here.keys()
        return total - math.log10(ppm.SYMBOLS - len(excluded))


def test_partial_matching(spark, folder):
    rows, docs = documents(spark, 60, folder)
    rows = [(r[0], (r[1] or "")[:400]) for r in rows]
    docs = docs.withColumn("text", F.substring("text", 1, 400))
    is_held = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i, _ in rows]
    got = ppm.score(docs).collect()
    assert len(got) == len(rows)
    train = [t for (_, t), h in zip(rows, is_held) if not h]
    trie, order = Trie(train, ppm.ORDER), ppm.ORDER
    words = Counter(w for t in train for w in [*ppm.text_bytes(t).split(), b""])
    total = sum(words.values())
    want = {}
    for (i, t), h in zip(rows, is_held):
        data = bytes([ppm.START]) * order + ppm.text_bytes(t) + bytes([ppm.END])
        score = sum(trie.log10(data[at - order:at], data[at]) for at in range(order, len(data)))
        tokens_ = [*ppm.text_bytes(t).split(), b""]
        base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (len(words) + 1))) for w in tokens_)
        want[i] = (h, len(tokens_), sum(words[w] > 0 for w in tokens_), total), base, score
    for r in got:
        exact, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == exact
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_probabilities_add_up(spark):
    trie = Trie(["abab abba", "ab"], 2)
    asked = [b"\xff\xff", b"ab", b"zz", b"b "]
    rows = [(int.from_bytes(c + bytes([s]), "big"), trie.counts[2].get(c, {}).get(s, 0)) for c in asked for s in range(ppm.SYMBOLS)]
    seen = {g for g, _ in rows}
    rows += [(g, n) for c, symbols in trie.counts[2].items() for s, n in symbols.items() if (g := int.from_bytes(c + bytes([s]), "big")) not in seen]
    sums = defaultdict(float)
    for r in ppm.code_lengths(frame(spark, rows, "gram bigint, n bigint"), 2).collect():
        sums[(r.gram >> 8).to_bytes(2, "big")] += 10 ** r.p
    assert all(math.isclose(sums[c], 1, rel_tol=1e-9) for c in asked)


def test_scores_without_training(spark):
    assert ppm.score(nothing(spark)).count() == 0
    held = frame(spark, [(None, "ab"), (None, None)], "doc_id bigint, text string")
    assert sorted(r.score for r in ppm.score(held).collect()) == pytest.approx([-3 * math.log10(255), -math.log10(255)])


def test_adaptive(spark):
    docs = frame(spark, [(1, "abc" * 50), (2, None), (3, "xyzq" * 10)], "doc_id bigint, text string")
    got = {r.doc_id: r.adaptive_score for r in ppm.adaptive(docs).collect()}
    assert math.isclose(got[2], -math.log10(255)) and got[1] / 151 > -0.2
    first = -math.log10(255)  # an empty trie, then one symbol seen: its share is given to the escape in part
    assert math.isclose(ppm.adaptive_length("a", 0), first + math.log10(ppm.GIVEN) - math.log10(254))


def test_code_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000))
    table = ppm.CodeTable(keys, keys.astype(float))
    assert (table[np.repeat(keys, 3)] == np.repeat(keys, 3)).all()
    with pytest.raises(KeyError):
        table[np.array([1 << 50])]


# ------------------------------------------------------------------ classifier
def test_classifier(spark):
    draw = np.random.default_rng(4)
    good = [" ".join(draw.choice(["tree", "river", "stone", "cloud", "wind"], 30)) for _ in range(150)]
    bad = [" ".join(w + "###" for w in draw.choice(["tree", "river", "stone"], 30)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, None), (500, ""), (501, "wind " * 20_000)]
    docs = frame(spark, [(i, t, 0.5) for i, t in rows], "doc_id bigint, text string, score double")
    labels = frame(spark, [(i, int(i < 150), 0) for i in range(210)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    got = nbsvm.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 210]
    assert len(held) > 30 and all(r.predicted == int(r.doc_id < 150) for r in held)
    assert nbsvm.classify(nothing(spark), labels).count() == 0


def test_no_or_one_class(spark):
    docs = frame(spark, [(i, "x y") for i in range(6)], "doc_id bigint, text string")
    none = frame(spark, [], "doc_id bigint, quality int")
    assert {r.score for r in nbsvm.classify(docs, none).collect()} == {0.5}
    ones = frame(spark, [(i, 1) for i in range(6)], "doc_id bigint, quality int")
    assert {r.predicted for r in nbsvm.classify(docs, ones).collect()} == {1}


def test_dual_coordinate_descent():
    x = [np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])]
    w, bias = nbsvm.dual_coordinate_descent(x, np.array([1.0, 1, -1, -1]), np.ones(3), cost=10, epochs=200)
    assert all((w[r].sum() + bias) * y >= 0.99 for r, y in zip(x, [1, 1, -1, -1]))
    assert re.match(r"^-?0", f"{w[2]:.1f}")
