"""Packs: bounded groups of documents that pull just the table rows they need.

A table too large to send to every task (words with their ids, contexts with their code
lengths) is joined once per pack and key instead of once per occurrence.  Documents are
grouped by the file split they come from, cut further by a hash of the row where a split is
large.  The caller lists each pack's distinct keys and joins them to its table, and
``assembled`` brings a pack's documents, compressed, and its part of the table together.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: text bytes of a pack, about; of a compressed block of documents in it; keys held before a task hands them on
PACK_BYTES, BLOCK_BYTES, HELD_KEYS = 32 << 20, 4 << 20, 1_000_000


BLOCK = "pack bigint, kind int, block binary"


def with_packs(docs: DataFrame, text: str = "text", pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``docs`` with a column ``pack``: a hash of the file split, and of the row where splits are larger than a pack.

    Rows that come from no file are one split.  Every evaluation gives the same packs as
    long as the files and the session's split size stay the same.
    """
    split = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    # splits of like length hold like amounts of text: a class for each power of two, and in it as many parts as its largest split needs
    length = F.floor(F.log2(F.greatest(F.input_file_block_length(), F.lit(1)))).cast("int")
    sizes = (docs.select(split.alias("split"), length.alias("length"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n"))
             .groupBy("split", "length").agg(F.sum("n").alias("n")))
    parts = F.lit(1)
    for r in sizes.groupBy("length").agg(F.max("n").alias("n")).where(F.col("n") > pack_bytes).collect():
        parts = F.when(length == r.length, F.lit(-(-r.n // pack_bytes))).otherwise(parts)
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), parts)
    return docs.withColumn("pack", F.xxhash64(F.input_file_name(), F.input_file_block_start(), part))


def by_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each batch cut into the rows of its packs."""
    for batch in batches:
        packs = batch.column("pack")
        kinds = packs.unique().to_pylist()
        if len(kinds) == 1:
            yield kinds[0], batch
            continue
        rows: dict[int, list[int]] = {}
        for i, p in enumerate(packs.to_pylist()):
            rows.setdefault(p, []).append(i)
        for p, at in rows.items():
            yield p, batch.take(pa.array(at))


def hand_back_memory() -> None:
    """Return what a finished pack has freed to the system: Python workers live on, and their task's neighbours need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def squeezed(rows: pa.Table) -> bytes:
    """A table, compressed; nulls only in numbers that don't ascend.

    Texts are their lengths and one run of bytes, which takes less than offsets; long
    integers that ascend are their differences.
    """
    columns = {}
    for name, column in zip(rows.column_names, rows.columns):
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            raw = column.cast(pa.large_binary()).combine_chunks()
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
            data = memoryview(raw.buffers()[2] or b"")[ends[0]:ends[-1]]
            columns[f"n_{name}"] = pa.array([np.diff(ends).astype(np.uint32).tobytes()])
            columns[f"{'s' if pa.types.is_string(column.type) else 'b'}_{name}"] = pa.array([bytes(data)])
        else:
            values = column.combine_chunks()
            kind = "v"
            if pa.types.is_int64(values.type) and not values.null_count and len(values):
                steps = np.diff(values.to_numpy(), prepend=0)
                if (steps[1:] >= 0).all():
                    kind, values = "d", pa.array(steps)
            columns[f"{kind}_{name}"] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unsqueezed(block: bytes) -> pa.Table:
    """The table of ``squeezed``."""
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(block)).read_all().combine_chunks()
    columns = {}
    for name in table.column_names:
        kind, rest = name[0], name[2:]
        if kind == "v":
            columns[rest] = table[name].chunk(0).flatten()
        elif kind == "d":
            columns[rest] = pa.array(np.cumsum(table[name].chunk(0).flatten().to_numpy()))
        elif kind != "n":
            lengths = np.frombuffer(table[f"n_{rest}"][0].as_py(), np.uint32)
            ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
            data = table[name][0].as_buffer()
            kind = pa.large_string() if kind == "s" else pa.large_binary()
            columns[rest] = pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(ends.tobytes()), data])
    return pa.table(columns)


def _blocks(kind: int):
    """Rows as compressed tables, one for each block of a pack."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        sizes: dict[int, int] = {}

        def pressed(pack: int) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held.pop(pack))
            sizes.pop(pack)
            return pa.RecordBatch.from_pydict({"pack": pa.array([pack], pa.int64()), "kind": pa.array([kind], pa.int32()),
                                               "block": [squeezed(rows)]})

        for pack, batch in by_pack(batches):
            rows = batch.drop_columns(["pack"])
            step = max(1, int(rows.num_rows * BLOCK_BYTES / max(1, rows.nbytes)))
            for at in range(0, rows.num_rows, step):
                part = rows.slice(at, step)
                held.setdefault(pack, []).append(part)
                sizes[pack] = sizes.get(pack, 0) + part.nbytes
                if sizes[pack] >= BLOCK_BYTES:
                    yield pressed(pack)
            while sum(sizes.values()) >= 8 * BLOCK_BYTES:
                yield pressed(max(sizes, key=sizes.__getitem__))
        for pack in list(held):
            yield pressed(pack)
        hand_back_memory()
    return run


def assembled(packed: DataFrame, pulled: DataFrame, use: Callable[[pa.Table | None], Callable[[pa.Table], pa.RecordBatch]], schema: str) -> DataFrame:
    """For each pack ``use(its part of the table)`` is applied to its documents, block by block.

    Both sides travel as compressed blocks.  What a task holds of a pack is these blocks, the
    table rows that its documents need (None if they need none), and one block's result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        blocks = {kind: [b for k, b in zip(rows["kind"].to_pylist(), rows["block"].to_pylist()) if k == kind] for kind in (0, 1)}
        parts = [unsqueezed(b) for b in blocks[1]]
        apply = use(pa.concat_tables(parts) if parts else None)
        del parts
        for block in blocks[0]:
            yield apply(unsqueezed(block))
        del apply
        hand_back_memory()

    both = packed.mapInArrow(_blocks(0), BLOCK).unionByName(pulled.mapInArrow(_blocks(1), BLOCK))
    return both.groupBy("pack").applyInArrow(run, schema)
