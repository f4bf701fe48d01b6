"""WARC records, the merged index, and archives read back."""

import base64
import hashlib
import random
from collections import defaultdict
from datetime import datetime, timezone

import pytest

from llm.helpers import frame
from probatum.llm import warc

AT = datetime(2020, 1, 2, tzinfo=timezone.utc)


@pytest.mark.parametrize("runs", [[], [[]], [[3]], [[1, 4], [], [2, 2, 9]], [sorted(random.Random(i).choices(range(50), k=i)) for i in range(13)]])
def test_loser_tree(runs):
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_record_round_trip():
    payload = "é\r\n\r\nx".encode()
    got = warc.parse(warc.record(7, "http://a.b/c d\r\né", AT, payload, None, False))
    assert got["payload"] == payload and got["page_id"] == 7 and got["url"] == "http://a.b/c%20d%0D%0A%C3%A9" and got["captured"] == AT
    again = warc.parse(warc.record(None, None, AT, payload, 7, True))
    assert (again["record_type"], again["refers_to"], again["payload_bytes"], again["payload"], again["page_id"]) == ("revisit", 7, len(payload), None, None)


def test_url_keys():
    assert warc.url_key("https://www.a.example.com:81/B?q=1#x") == "com,example,a:81)/b?q=1"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_archive(spark, monkeypatch):
    pages = [(i, f"http://h{i % 3}.org/{i % 5}", f"<p>{i % 9}</p>" if i % 7 else "") for i in range(80)]
    pages += [(100, None, None), (None, "http://x.org", "<p>1</p>"), (None, "http://x.org", "alone"), (101, "http://y.org", "x" * 300_000), (5, "http://h2.org/0", "<p>5</p>")]
    df = frame(spark, [(*p, "k", 1) for p in pages], "page_id bigint, url string, html string, digest string, bytes int").repartition(4)
    archive = warc.Archive.write(df)
    got = archive.read().collect()
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[(html or "").encode()].append(i)
    assert len(got) == len(pages)
    for r in got:
        size, digest = next((len(p), p) for p in groups if base64.b32encode(hashlib.sha1(p).digest()).decode() == r.payload_digest)
        ids = [i for i in groups[digest] if i is not None]
        last = max(ids, default=None)
        is_response = len(groups[digest]) == 1 or r.page_id == last
        assert (r.payload_bytes, r.record_type, r.refers_to) == (size, "response" if is_response else "revisit", None if is_response else last)
        assert r.payload == (digest if is_response else None)
    order = [warc._order(c.asDict()) for c in archive.index.collect()]
    assert order == sorted(order) and len(order) == len(pages)
    empty = warc.Archive.write(df.limit(0))
    assert empty.read().count() == 0


def test_small_payloads_are_responses(spark):
    df = frame(spark, [(1, None, "ab"), (2, None, "ab"), (3, None, "abcd"), (4, None, "abcd")], "page_id bigint, url string, html string")
    got = {r.page_id: r.record_type for r in warc.Archive.write(df, least_bytes=3).read().collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
