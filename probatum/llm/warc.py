"""WARC archives with an external capture index merged from sorted runs.

Every task writes archive files and, for each file, a run of capture entries sorted by URL
key and time.  Runs are dealt out by key ranges; in a range a loser tree merges the pieces
of all runs, so that the ranges one after the other are the ordered capture histories.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.llm.shared import shared_folder, written

#: an archive file, and with it a run of the index, is closed after so many records or bytes
FILE_RECORDS, FILE_BYTES = 20_000, 256 << 20
#: captures in one range of the merged index
RANGE_CAPTURES = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = ("url_key string, captured timestamp, page_id bigint, file string, place int, offset bigint, length bigint, "
           "record_type string, payload_digest string")
RECORD = ("page_id bigint, url string, captured timestamp, record_type string, refers_to bigint, payload_digest string, "
          "payload_bytes bigint, payload binary")


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; empty for null."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:  # not a URL by the rules: its own key
        return url.lower()
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/").lower() + (f"?{parts.query}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    return int(n) if (n := name.removeprefix("<urn:page:").rstrip(">")) else None


def record(page_id: int | None, url: str | None, captured: datetime, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record, compressed by itself.  A revisit keeps the HTTP head, which has the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _name(page_id)),
            ("WARC-Date", captured.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%") + "%")))
    if is_revisit:
        head += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def parse(packed: bytes) -> dict:
    """The fields of ``RECORD`` from one compressed record."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    is_revisit = fields["WARC-Type"] == "revisit"
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:]) if is_revisit else len(payload)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not is_revisit and digest_of(payload) != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload does not match its digest")
    return {"page_id": _number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
            "captured": datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc),
            "record_type": fields["WARC-Type"], "refers_to": _number(fields["WARC-Refers-To"]) if is_revisit else None,
            "payload_digest": digest, "payload_bytes": size, "payload": None if is_revisit else payload}


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so that the next winner costs one path."""

    def __init__(self, runs: list[Iterator], key):
        self._runs, self._key = runs, key
        self._heads = [next(r, None) for r in runs]
        self._n = max(1, len(runs))
        self._nodes = [-1] * self._n  # node 0 holds the winner
        for run in range(len(runs)):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        """Whether the head of ``a`` comes before that of ``b``; an ended run loses, ties go to the lower run."""
        x, y = self._heads[a], self._heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (self._key(x), a) < (self._key(y), b)

    def _play(self, run: int) -> None:
        at = (run + self._n) // 2
        while at:
            held = self._nodes[at]
            if held < 0:  # while the tree fills, the first to come waits for its opponent
                self._nodes[at] = run
                return
            if self._beats(held, run):
                self._nodes[at], run = run, held
            at //= 2
        self._nodes[0] = run

    def __iter__(self) -> Iterator:
        while self._runs and (head := self._heads[winner := self._nodes[0]]) is not None:
            yield head
            self._heads[winner] = next(self._runs[winner], None)
            self._play(winner)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_UTC = pa.timestamp("us", tz="UTC")
_CAPTURE = pa.schema([("url_key", pa.string()), ("captured", _UTC), ("page_id", pa.int64()), ("file", pa.string()), ("place", pa.int32()),
                      ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("captured", _UTC), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _order(capture: dict) -> tuple:
    return capture["url_key"], capture["captured"], capture["page_id"] is None, capture["page_id"] or 0


def writer(folder: str):
    """Writes the records of a partition; the rows it returns are the sorted runs, one for each file.

    A file's name is new for each attempt, and readers open only files that the returned
    rows name: what a lost attempt has left is never read.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, run, offset, name = None, [], 0, ""

        def close() -> list[pa.RecordBatch]:
            nonlocal out, run
            if out is None:
                return []
            out.close()
            run.sort(key=_order)
            batch = _table([c | {"place": i} for i, c in enumerate(run)], _CAPTURE)
            out, run = None, []
            return [batch]

        for row in _rows(batches):
            if out is None:
                name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            payload = (row["html"] or "").encode()
            packed = record(row["page_id"], row["url"], row["captured"], payload, row["refers_to"], row["is_revisit"])
            out.write(packed)
            run.append({"url_key": url_key(row["url"]), "captured": row["captured"], "page_id": row["page_id"], "file": name, "offset": offset,
                        "length": len(packed), "record_type": "revisit" if row["is_revisit"] else "response", "payload_digest": digest_of(payload)})
            offset += len(packed)
            if len(run) >= FILE_RECORDS or offset >= FILE_BYTES:
                yield from close()
        yield from close()
    return write


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of one range, which come run by run, in global order."""
    runs: dict[str, list[dict]] = {}
    for capture in _rows(batches):
        runs.setdefault(capture["file"], []).append(capture)
    merged = list(LoserTree([iter(r) for r in runs.values()], _order))
    for at in range(0, len(merged), 10_000):
        yield _table(merged[at:at + 10_000], _CAPTURE)


def reader(folder: str):
    """Reads the records that the captures point at; a file is opened once while its captures follow one another."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        source, name, out, size = None, None, [], 0
        for capture in _rows(batches):
            if capture["file"] != name:
                if source:
                    source.close()
                name = capture["file"]
                source = store.open_input_file(f"{base}/{name}")
            out.append(parse(source.read_at(capture["length"], capture["offset"])))
            size += out[-1]["payload_bytes"]
            if size > 8 << 20 or len(out) >= 5000:
                yield _table(out, _RECORD)
                out, size = [], 0
        if source:
            source.close()
        if out:
            yield _table(out, _RECORD)
    return read


class Archive:
    """Archive files in a folder of the shared store, and their merged capture index."""

    def __init__(self, folder: str, index: DataFrame):
        self.folder, self.index = folder, index

    @classmethod
    def write(cls, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
              captured: Column | None = None, least_bytes: int = 0) -> Archive:
        """Write a record per row and merge the index.

        Of rows with equal payloads of ``least_bytes`` or more, that with the largest id is a
        response and the others are revisits of it (rows that share that id are responses
        each; where all ids are null, all are).  A null payload counts as empty, a null URL
        has the empty key and no target field.  ``captured`` is the time of capture (default:
        the id in seconds since 1970, null ids at 0).  An empty table gives an archive
        without files.  Further columns are not read.
        """
        at = captured if captured is not None else F.timestamp_seconds(F.coalesce(F.col(page_id), F.lit(0)))
        rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), at.alias("captured"),
                            F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")).alias("digest"),
                            F.coalesce(F.octet_length(html), F.lit(0)).alias("bytes"))
        copies = (rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1 AND refers_to IS NOT NULL").drop("n"))
        # both sides are shuffled for this join, so that copies of one page can be split
        joined = rows.join(written(copies, "copies"), "digest", "left")
        is_revisit = F.coalesce((F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull(), F.lit(False))
        ready = joined.select("page_id", "url", "html", "captured", F.when(is_revisit, F.col("refers_to")).alias("refers_to"), is_revisit.alias("is_revisit"))
        folder = shared_folder(pages.sparkSession, "warc")
        runs = written(ready.mapInArrow(writer(folder), CAPTURE), "runs")
        ranges = max(1, -(-runs.count() // RANGE_CAPTURES))
        dealt = (runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "file").sortWithinPartitions("file", "place"))
        return cls(folder, written(dealt.mapInArrow(merge_runs, CAPTURE), "captures"))

    def read(self) -> DataFrame:
        """All records, as ``RECORD``; payloads of revisits are null, their length and digest are those of the full payload."""
        # entries are small and records are not: a number of partitions that is given is not made smaller by their size
        n_files = max(1, self.index.select("file").distinct().count())
        by_file = self.index.select("file", "offset", "length").repartition(n_files, "file").sortWithinPartitions("file", "offset")
        return by_file.mapInArrow(reader(self.folder), RECORD)
