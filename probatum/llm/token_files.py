"""Token-id files: one zstandard frame per document, a dictionary shared by all, an offset index.

A file is the frames of its documents in order of id, then an Arrow table with the offset
index, then a JSON line (the dictionary's hash, id width, where the index starts) and that
line's length in 4 bytes.  One document is read by its index row and one frame.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probatum.llm.shared import shared_folder, written
from probatum.llm.tokens import WordIds, plain_splitter, slices, vocabulary

END_ID = 2
#: the dictionary is trained on about so many documents, chosen by hash, and so many bytes of each, in pieces where it is longer
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 1 << 16, 64 << 10
PIECE_BYTES = 4 << 10
#: bytes of frames in a file, about
FILE_BYTES = 128 << 20
WIDTH = "<u2"  # the vocabulary has fewer than 65,536 ids

_FRAME = "doc_id bigint, n_tokens bigint, frame binary"
_FRAMES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])
_FILE = "file string, part int, nth int, n_docs bigint, n_tokens bigint"
_FILES = pa.schema([("file", pa.string()), ("part", pa.int32()), ("nth", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_DOC = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordIds:
    return WordIds(plain_splitter(path), WIDTH)


def encoded(texts: list[str], path: str, end_id: int) -> Iterator[bytes]:
    """Serialized ids of each text with the end id behind it."""
    for a, b in slices([len(t) for t in texts], 4 << 20):
        for ids in _encoder(path).packed(texts[a:b]):
            yield ids + np.array(end_id, dtype=WIDTH).tobytes()


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def sampled(ids: bytes) -> bytes:
    """Serialized ids for training: all of a short array, of a long one pieces at hashed positions over its whole length."""
    if len(ids) <= SAMPLE_BYTES:
        return ids
    width, digest = np.dtype(WIDTH).itemsize, xxhash.xxh64_digest(ids)
    places = (len(ids) - PIECE_BYTES) // width + 1
    starts = sorted(xxhash.xxh64_intdigest(digest, seed=i) % places * width for i in range(SAMPLE_BYTES // PIECE_BYTES))
    return b"".join(ids[a:a + PIECE_BYTES] for a in starts)


def train_dictionary(docs: DataFrame, path: str, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary from a bounded sample of documents; empty when there is too little to train on."""
    rows = docs.select("doc_id", "text")
    n = rows.count()
    chance = F.pmod(F.xxhash64("doc_id", F.col("text")), F.lit(max(1, n // SAMPLE_DOCS)))

    def serialize(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"ids": [sampled(x) for x in encoded(_texts(batch), path, end_id)]})
    # copies of one row share a hash: the bound on the sample is a hard one
    sample = [bytes(r.ids) for r in rows.where(chance == 0).mapInArrow(serialize, "ids binary").limit(4 * SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _unpacker(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _write_file(folder: str, part: int, nth: int, rows: list[tuple], digest: str) -> pa.RecordBatch:
    """One file from rows (doc_id, n_tokens, frame); its name is new for each attempt."""
    store, base = pafs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}.tokens"
    ids, counts, frames = zip(*rows)
    offsets = np.cumsum([0, *map(len, frames)])
    index = pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                      "offset": offsets[:-1], "length": np.diff(offsets)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema) as out:
        out.write_table(index)
    tail = json.dumps({"dictionary": digest, "width": WIDTH, "index_at": int(offsets[-1])}).encode()
    with store.open_output_stream(f"{base}/{name}", compression=None) as out:
        for frame in frames:
            out.write(frame)
        out.write(sink.getvalue())
        out.write(tail + len(tail).to_bytes(4, "little"))
    return pa.RecordBatch.from_pylist([{"file": name, "part": part, "nth": nth, "n_docs": len(rows), "n_tokens": int(sum(counts))}], schema=_FILES)


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, folder: str, name: str, dictionary: bytes | None = None):
        store, base = pafs.FileSystem.from_uri(folder)
        self._source = store.open_input_file(f"{base}/{name}")
        end = self._source.size()
        size = int.from_bytes(self._source.read_at(4, end - 4), "little")
        head = json.loads(self._source.read_at(size, end - 4 - size))
        if dictionary is None:
            with store.open_input_file(f"{base}/dictionary-{head['dictionary']}") as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != head["dictionary"]:
            raise ValueError(f"{name} was written with another dictionary")
        at = head["index_at"]
        self.index = pa.ipc.open_stream(self._source.read_at(end - 4 - size - at, at)).read_all()
        self._width, self._unpack = head["width"], _unpacker(dictionary)

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document in index row ``row``."""
        frame = self._source.read_at(self.index["length"][row].as_py(), self.index["offset"][row].as_py())
        return np.frombuffer(self._unpack.decompress(frame), dtype=self._width)

    def close(self) -> None:
        self._source.close()


class TokenFiles:
    """The files of one corpus: a folder, and the table of its files in order with their first token's position."""

    def __init__(self, folder: str, files: DataFrame, dictionary: bytes):
        self.folder, self.files, self.dictionary = folder, files, dictionary

    @classmethod
    def write(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
              vocabulary_file: str = "word_bpe_49k.json", end_id: int = END_ID) -> TokenFiles:
        """Encode and write every row in ascending order of id.

        Null texts count as empty and have the end id alone.  Null ids come last; rows that
        share an id follow one another in order of their frames.  An empty table gives no
        file.  Further columns are not read.
        """
        path = vocabulary(vocabulary_file)
        rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        dictionary = train_dictionary(rows, path, end_id)
        digest = hashlib.sha256(dictionary).hexdigest()
        folder = shared_folder(docs.sparkSession, "tokens")
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/dictionary-{digest}", compression=None) as f:
            f.write(dictionary)

        def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = _packer(dictionary)
            for batch in batches:
                texts, ids = _texts(batch), batch.column("doc_id")
                at = 0
                for a, b in slices([len(t) for t in texts], 8 << 20):
                    raw = list(encoded(texts[a:b], path, end_id))
                    counts = [len(x) // np.dtype(WIDTH).itemsize for x in raw]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, b - a), pa.array(counts, pa.int64()), pa.array([pack.compress(x) for x in raw], pa.binary())], schema=_FRAMES)
                    at = b

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, part, nth = [], 0, 0, 0
            for batch in batches:
                for doc, n, frame, part in zip(*[c.to_pylist() for c in batch.columns]):
                    held.append((doc, n, frame))
                    size += len(frame)
                    if size >= FILE_BYTES:
                        yield _write_file(folder, part, nth, held, digest)
                        held, size, nth = [], 0, nth + 1
            if held:
                yield _write_file(folder, part, nth, held, digest)

        frames = written(rows.mapInArrow(compress, _FRAME), "frames")
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("frame")]
        dealt = frames.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        files = written(dealt.mapInArrow(write, _FILE), "files")
        # a row per file, that is per 100 MB or so of frames
        before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
        starts = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        return cls(folder, written(starts, "starts"), dictionary)

    def read(self) -> DataFrame:
        """``doc_id, start, n_tokens, ids`` of every document, read back; ``ids`` are little-endian 32-bit integers."""
        folder, dictionary = self.folder, self.dictionary

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for r in b.to_pylist()):
                source, start, out, size = TokenFile(folder, row["file"], dictionary), row["start"], [], 0
                for i, (doc, n) in enumerate(zip(source.index["doc_id"].to_pylist(), source.index["n_tokens"].to_pylist())):
                    out.append({"doc_id": doc, "start": start, "n_tokens": n, "ids": source.ids(i).astype("<u4").tobytes()})
                    start, size = start + n, size + 4 * n
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=_DOCS)
                        out, size = [], 0
                source.close()
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_DOCS)

        # rows are small and files are not: a number of partitions that is given is not made smaller by their size
        n_files = max(1, self.files.count())
        return self.files.select("file", "start").repartition(n_files, "file").mapInArrow(read, _DOC)

