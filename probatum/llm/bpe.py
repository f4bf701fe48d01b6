"""Byte-level BPE over a table of distinct words.

Texts are cut into words in tasks; the distinct words of all texts are encoded once each.
Every pack of documents pulls the rows of its own words and puts its ids together by
position.  Ids are decoded by lookup in an array of the vocabulary's pieces, which has a
fixed size and goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.packs import HELD_KEYS, assembled, by_pack, hand_back_memory, with_packs
from probatum.llm.tokens import byte_letters, byte_splitter, tokenizer, vocabulary

#: ids in a word's packed form; the vocabulary has fewer than 65,536
PACKED, PACKED_BYTES = "<u2", 2


def pieces(path: str) -> pa.Array:
    """The bytes of each id, in order of id; gaps are empty."""
    library, letters = tokenizer(path), byte_letters()
    special = {i: t.content.encode() for i, t in library.get_added_tokens_decoder().items()}
    known = {i: bytes(letters[c] for c in piece) for piece, i in library.get_vocab(with_added_tokens=False).items()} | special
    return pa.array([known.get(i, b"") for i in range(max(known) + 1)], pa.binary())


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``word, packed`` for ``words(word)``: each row is encoded once, ``packed`` has its ids."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            packed = [np.array(ids, PACKED).tobytes() for ids in byte_splitter(path).encode(words.to_pylist())]
            yield pa.RecordBatch.from_arrays([words, pa.array(packed, pa.binary())], names=["word", "packed"])
    return words.mapInArrow(encode, "word string, packed binary")


def joined_pieces(ids: np.ndarray, ends: np.ndarray, table: pa.Array) -> list[str]:
    """The texts that runs of ids decode to: ids meet the table of pieces, and the pieces of a run stand one after the other."""
    met = table.take(pa.array(ids))
    offsets = np.frombuffer(met.buffers()[1], np.int32)[:len(ids) + 1]
    data = met.buffers()[2].to_pybytes() if len(ids) else b""
    cuts = offsets[ends]
    return [data[a:b].decode(errors="replace") for a, b in zip(cuts[:-1], cuts[1:])]


def _distinct_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = byte_splitter(path).words
        held: dict[int, set[str]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for pack, words in held.items():
                listed = sorted(words)  # neighbours share their beginnings, which the shuffle's compression uses
                for at in range(0, len(listed), 100_000):
                    part = listed[at:at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([pack] * len(part), pa.int64()), pa.array(part, pa.string())], names=["pack", "word"])
            held.clear()

        for pack, batch in by_pack(batches):
            words = held.setdefault(pack, set())
            for text in batch.column("text"):
                words.update(cut(text.as_py() or ""))
            if sum(map(len, held.values())) > HELD_KEYS:
                yield from hand_on()
        yield from hand_on()
        hand_back_memory()
    return run


def _put_together(path: str):
    table = pieces(path)  # as large as the vocabulary's file; sent along with the tasks

    def use(part: pa.Table | None):
        ids_of = dict(zip(part["word"].to_pylist(), part["packed"].to_pylist())) if part is not None else {}
        cut = byte_splitter(path).words

        def apply(docs: pa.Table) -> pa.RecordBatch:
            packed = [b"".join(map(ids_of.__getitem__, cut(t.as_py() or ""))) for t in docs["text"]]
            ends = np.cumsum([0, *(len(p) // PACKED_BYTES for p in packed)], dtype=np.int32)
            ids = np.frombuffer(b"".join(packed), PACKED).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            return pa.RecordBatch.from_arrays([docs["doc_id"].combine_chunks(), lists, pa.array(joined_pieces(ids, ends, table), pa.string())],
                                              names=["doc_id", "ids", "decoded"])
        return apply
    return use


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_file: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id, ids, decoded`` for every row: the ids of the whole text, and the text that they decode to.

    Null and empty texts have no ids.  Special tokens that a text spells out are single ids.
    Null and repeated ids are kept as they are; an empty table gives no rows; further
    columns are not read.
    """
    path = vocabulary(vocabulary_file)
    kind = docs.schema[doc_id].dataType.simpleString()
    packed = with_packs(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    # dealt by word once, for the distinct words and for the join that follows
    asked = packed.select("pack", "text").mapInArrow(_distinct_words(path), "pack bigint, word string").where("word IS NOT NULL").repartition("word")
    # words are never null and the count never 0: with both, the readers of that exchange are alike and Spark makes it once
    distinct = asked.groupBy("word").agg(F.count("pack").alias("n_packs")).where("n_packs > 0").select("word")
    # in order, so that the rows on their way back take less
    distinct = distinct.sortWithinPartitions("word")
    pulled = asked.join(encode_words(distinct, path), "word").select("pack", "word", "packed")
    return assembled(packed, pulled, _put_together(path), f"doc_id {kind}, ids array<int>, decoded string")
