"""Prediction by partial matching over bytes: code lengths of whole documents.

The model is a trie of byte contexts up to a given order.  A symbol that was seen in its
context costs its share of that context's counts; else an escape is paid and the context
is shortened, where the symbols of the longer context no longer count (symbol exclusion).
Each symbol gives a part of its first count to the escape, whose share is thus that part of
the number of distinct symbols over the count.  A shorter context counts a symbol once for
each context one byte longer that it was new in (update exclusion).

Pretrained, the counts of all training documents are a table of (context, symbol) rows.
Because a context's symbols are also symbols of every shorter one, each escape depends on a
context and its suffix alone, so that code lengths of all pairs are worked out level by
level with joins on the suffix.  Packs of documents then pull the pairs that they contain.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from probatum.llm.packs import HELD_KEYS, assembled, by_pack, hand_back_memory, with_packs
from probatum.llm.shared import id_remainder, scope, written

#: bytes of context; at most 6, so that context and symbol fit 7 bytes of a long
ORDER = 5
#: bytes that UTF-8 never has: before a text, and the symbol that ends it
START, END = 0xFF, 0xFE
SYMBOLS = 255  # all bytes but START can be coded
#: of each symbol's count, what the escape gets
GIVEN = 0.25
SMOOTH = 0.1


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode().lower()


def codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every position of every text as one number, and where each text starts."""
    pad = bytes([START]) * order
    joined = pad + (bytes([END]) + pad).join(texts) + bytes([END])
    data = np.frombuffer(joined, dtype=np.uint8)
    out = np.zeros(len(data) - order, dtype=np.int64)
    for j in range(order + 1):
        out = (out << 8) | data[j:len(data) - order + j]
    return out[data[order:] != START], np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])


# ------------------------------------------------------------------ the trie's table
def _suffix(gram: str | Column, size: int) -> Column:
    """The last ``size`` bytes of a code."""
    return (F.col(gram) if isinstance(gram, str) else gram).bitwiseAND(F.lit((1 << 8 * size) - 1))


def code_lengths(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, p)`` from ``counts(gram, n)``: log10 of the symbol's probability after its context.

    ``gram`` holds ``order`` bytes of context and the symbol; pairs with ``n`` 0 ask for the
    probability of what training never had.
    """
    # each level is read for the next shorter one and for its own code lengths, and then deleted
    levels = {order: written(counts.select("gram", F.col("n").alias("c")), "grams", readers=2)}
    for k in range(order - 1, -1, -1):
        shorter = levels[k + 1].groupBy(_suffix("gram", k + 1).alias("gram")).agg(F.count_if(F.col("c") > 0).alias("c"))
        levels[k] = written(shorter, "grams", readers=2 if k else 1)

    def paid(share: Column, of: Column) -> Column:
        # where nothing is left, nothing asks for the share: null
        return F.log10(F.try_divide(share.cast("double"), of))

    # without context: a symbol never seen is one of those left
    n, d = levels[0].agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n, d = n or 0, d or 0
    left = -float(np.log10(max(1, SYMBOLS - d)))
    seen = F.when(F.col("c") > 0, paid(F.col("c") - GIVEN, F.lit(n))).otherwise(F.lit(float(np.log10(GIVEN * d / n)) + left if d else left))
    known = levels[0].select("gram", "c", F.lit(n).alias("n"), F.lit(d).alias("d"), F.lit(left).alias("r"), seen.alias("p"))
    for k in range(1, order + 1):
        shorter = known.select(F.col("gram").alias("suffix"), F.col("c").alias("c_low"), F.col("n").alias("n_low"),
                               F.col("d").alias("d_low"), F.col("r").alias("r_low"), F.col("p").alias("p_low"))
        pairs = (levels[k].withColumn("suffix", _suffix("gram", k)).join(shorter, "suffix")
                 .withColumn("context", F.shiftright("gram", 8)))
        # a context has at most 255 symbols; what they hold in the shorter context is excluded there
        here = Window.partitionBy("context")
        is_seen = F.col("c") > 0
        pairs = (pairs.withColumn("n", F.sum("c").over(here)).withColumn("d", F.count_if(is_seen).over(here))
                 .withColumn("n_left", F.max("n_low").over(here) - F.sum(F.when(is_seen, F.col("c_low")).otherwise(F.lit(0))).over(here))
                 .withColumn("d_left", F.max("d_low").over(here) - F.col("d")))
        escaped = F.when(F.col("c_low") > 0, paid(F.col("c_low") - GIVEN, F.col("n_left"))).otherwise(
            F.when(F.col("d_left") > 0, paid(GIVEN * F.col("d_left"), F.col("n_left"))).otherwise(F.lit(0.0)) + F.col("r_low"))
        p = (F.when(F.col("n") == 0, F.col("p_low")).when(F.col("c") > 0, paid(F.col("c") - GIVEN, F.col("n")))
             .otherwise(paid(GIVEN * F.col("d"), F.col("n")) + F.col("r")))
        told = pairs.withColumn("r", escaped).withColumn("p", p)
        known = written(told.select("gram", "p"), "lengths") if k == order else written(told.select("gram", "c", "n", "d", "r", "p"), "lengths", readers=1)
    return known.select("gram", "p")


# ------------------------------------------------------------------ counting and scoring
def _counted(order: int):
    """Each pack's distinct (context, symbol) pairs and words with their counts in training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, list] = {}
        words: dict[int, Counter] = {}
        held = 0

        def summed(found: list) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
            distinct, at = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)

        def hand_on() -> Iterator[pa.RecordBatch]:
            for pack in grams:
                keys, counts = summed(grams[pack])
                listed = [*words[pack].items()]
                n = len(keys)
                yield pa.RecordBatch.from_pydict({"pack": pa.array([pack] * n, pa.int64()), "gram": keys, "word": pa.nulls(n, pa.string()), "n": counts})
                for at in range(0, len(listed), 100_000):
                    part, numbers = zip(*listed[at:at + 100_000])
                    yield pa.RecordBatch.from_pydict({"pack": pa.array([pack] * len(part), pa.int64()), "gram": pa.nulls(len(part), pa.int64()),
                                                      "word": pa.array([w.decode() for w in part], pa.string()), "n": pa.array(numbers, pa.int64())})
            grams.clear()
            words.clear()

        for pack, batch in by_pack(batches):
            counter = words.setdefault(pack, Counter())
            found = grams.setdefault(pack, [])
            for learn in (True, False):
                for chosen in _parts(text_bytes(t.as_py()) for t, is_on in zip(batch.column("text"), batch.column("learns")) if is_on.as_py() is learn):
                    keys, counts = np.unique(codes(chosen, order)[0], return_counts=True)
                    found.append((keys, counts if learn else np.zeros_like(counts)))
                    for t in chosen:
                        counter.update(t.split() if learn else dict.fromkeys(t.split(), 0))
            if sum(len(k) for k, _ in found) > HELD_KEYS:
                found[:] = [summed(found)]
            held = sum(map(len, words.values())) + sum(len(k) for f in grams.values() for k, _ in f)
            if held > 2 * HELD_KEYS:
                yield from hand_on()
        yield from hand_on()
        hand_back_memory()
    return run


def _parts(texts: Iterable[bytes], most: int = 2 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of ``most`` bytes or little more."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


class CodeTable:
    """Values of many codes at once: a hash table in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, at = np.unique(keys, return_index=True)
        values = values[at]
        bits = max(4, int(2 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, dtype=np.int64)
        self._values = np.zeros(1 << bits)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self._keys[slot] == -1
            self._keys[slot[free]] = keys[left[free]]
            placed = self._keys[slot] == keys[left]
            self._values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self._values[slot]
        missed = np.flatnonzero(self._keys[slot] != keys)
        while len(missed):
            slot_now = (slot[missed] + 1) & self._mask
            if (self._keys[slot_now] == -1).any():
                raise KeyError("a code that the pack did not ask for")
            slot[missed] = slot_now
            out[missed] = self._values[slot_now]
            missed = missed[self._keys[slot_now] != keys[missed]]
        return out


def _scored(order: int, total: int, end_count: int, distinct: int):
    per_token = float(np.log10(total + SMOOTH * (distinct + 1)))
    end_value = float(np.log10(end_count + SMOOTH))
    unseen = float(np.log10(SMOOTH))

    def use(part: pa.Table | None):  # never None: every text has an end
        grams, value = part["gram"].to_numpy(), part["value"].to_numpy()
        is_gram = grams >= 0  # the others are words
        table = CodeTable(grams[is_gram], value[is_gram])
        named = part["word"].filter(pa.array(~is_gram)).to_pylist()
        words = dict(zip([w.encode() for w in named], np.log10(value[~is_gram] + SMOOTH).tolist()))

        def apply(docs: pa.Table) -> pa.RecordBatch:
            texts = [text_bytes(t.as_py()) for t in docs["text"]]
            lengths, starts = codes(texts, order)
            score = np.add.reduceat(table[lengths], starts)
            n_tokens, n_known, base = [], [], []
            for t in texts:
                values = [*map(words.__getitem__, t.split()), end_value]
                n_tokens.append(len(values))
                n_known.append(len(values) - values.count(unseen))
                base.append(sum(values) - per_token * len(values))
            n = len(texts)
            return pa.RecordBatch.from_pydict({
                "doc_id": docs["doc_id"].combine_chunks(), "held_out": docs["held_out"].combine_chunks(), "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([total] * n, pa.int64()),
                "base_score": pa.array(base, pa.float64()), "score": score})
        return apply
    return use


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, folds: int = 10) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Learns from the rows whose ``crc32(id) mod folds`` is not 0 (a null id counts as the
    empty text, which is held out) and scores all.  A-Z count as lower case; tokens are the
    words between ASCII white space and one end.  ``score`` is log10 of the model's
    probability of the text's bytes and its end, ``base_score`` that of the smoothed word
    frequencies.  Null texts count as empty and score their end.  Without training rows all
    symbols are equally likely.  Repeated rows count as often as they come; an empty table
    gives no rows; further columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (id_remainder(F.col(doc_id), folds) == 0).alias("held_out"))
    with scope(docs.sparkSession) as tables:
        packed = with_packs(rows)
        asked = written(packed.select("pack", "text", (~F.col("held_out")).alias("learns"))
                        .mapInArrow(_counted(order), "pack bigint, gram bigint, word string, n bigint"), "counts")
        words = written(asked.where("gram IS NULL").groupBy("word").agg(F.sum("n").alias("c")), "words")
        end_count = rows.where(~F.col("held_out")).count()
        in_words, distinct = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
        total, distinct = (in_words or 0) + end_count, distinct + (end_count > 0)
        grams = code_lengths(asked.where("word IS NULL").groupBy("gram").agg(F.sum("n").alias("n")), order)
        pulled = (asked.where("word IS NULL").join(grams, "gram").select("pack", "gram", F.lit("").alias("word"), F.col("p").alias("value"))
                  .unionByName(asked.where("gram IS NULL").join(words, "word").select("pack", F.lit(-1).cast("bigint").alias("gram"), "word", F.col("c").cast("double").alias("value"))))
        scored = written(assembled(packed, pulled, _scored(order, total, end_count, distinct),
                         f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"), "scores")
        tables.keep(scored)
    return scored


# ------------------------------------------------------------------ adaptive
def adaptive_length(text: str | None, order: int = ORDER) -> float:
    """log10 of the probability of a text under a model that starts empty and learns each symbol after coding it."""
    data = bytes([START]) * order + text_bytes(text) + bytes([END])
    trie: dict[bytes, Counter] = {}
    total = 0.0
    for at in range(order, len(data)):
        symbol, excluded, done = data[at], set(), False
        for k in range(order, -1, -1):
            seen = trie.get(data[at - k:at])
            if not seen:
                continue
            live = {s: c for s, c in seen.items() if s not in excluded}
            if not live:
                continue
            whole = sum(live.values())
            if done := symbol in live:
                total += float(np.log10((live[symbol] - GIVEN) / whole))
                break
            total += float(np.log10(GIVEN * len(live) / whole))
            excluded |= live.keys()
        if not done:
            total -= float(np.log10(SYMBOLS - len(excluded)))
        for k in range(order, -1, -1):
            seen = trie.setdefault(data[at - k:at], Counter())
            seen[symbol] += 1
            if seen[symbol] > 1:  # not new here: shorter contexts know it from this one
                break
    return total


def adaptive(docs: DataFrame, text: str = "text", order: int = ORDER, name: str = "adaptive_score") -> DataFrame:
    """``docs`` with the adaptive score of each text: every document by itself, nothing is gathered."""
    @F.arrow_udf(DoubleType())
    def lengths(texts: pa.Array) -> pa.Array:
        return pa.array([adaptive_length(t, order) for t in texts.to_pylist()], pa.float64())
    return docs.withColumn(name, lengths(F.col(text)))
