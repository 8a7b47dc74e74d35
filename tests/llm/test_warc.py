import base64
import gzip
import hashlib
import io

import pytest

from tabweft.llm import warc
from tabweft.llm.common import new_folder


def test_keys():
    assert warc.url_key("https://www.Example.com:443/a?b=1") == "com,example,www)/a?b=1"
    assert warc.url_key("http://x.org:8080") == "org,x:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("no host") == "no host" and warc.url_key("http://[bad") == "http://[bad"


def test_escaped_keys_keep_their_order():
    for key in ("a b", "a%20b", "a\n%0A%25", "plain"):
        assert warc._unescape(warc._escape(key)) == key or "%" in key
    rows = [("com,x)/a b", 1), ("com,x)/a!b", 2), ("com,x)/a b", 3)]
    assert sorted(k for k, _ in rows) == ["com,x)/a b", "com,x)/a b", "com,x)/a!b"]


def test_record_round_trip():
    payload = "é\r\n\r\n<html>".encode()
    raw = warc.record(5, "http://a.b/c\r\nX: y", payload, None, warc.digest_of(payload))
    assert warc.parse(raw)["payload"] == payload and warc.parse(raw)["page_id"] == 5
    r = warc.parse(warc.record(6, None, payload, 5, warc.digest_of(payload)))
    assert (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"]) == ("revisit", 5, len(payload), b"")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"<html>", b"<HTML>"))
    with pytest.raises(ValueError, match="short"):
        warc.parse(raw[:-3])


def test_archives_and_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    html = [None, "", "<p>" + "x" * 60_000, "été"] + ["same"] * 60 + [f"<p>{i}</p>" for i in range(90)]
    rows = [(i, f"http://h{i % 7}.example.com/p {i % 40}" if i % 9 else None, h) for i, h in enumerate(html)] + [(None, "http://z.example.com/", "same"), (1000, "bad\nurl", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = new_folder(spark, "test-warc")
    manifest = warc.write_index(warc.write_archives(pages, folder), folder)
    found = warc.read_archives(spark, folder, manifest, warc.request_keys(pages)).collect()
    got = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        payload = (h or "").encode()
        keep = first.setdefault(payload, i)
        r = got.pop(i)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if keep == i else ("revisit", keep))
    assert not got
    index = warc.CaptureIndex.of(folder, manifest)
    assert sum(r.blocks for r in manifest.collect()) > 10 and len(index.files) > 1
    for url in {u for _, u, _ in rows if u}:
        want = sorted(str(i) for i, u, _ in rows if warc.url_key(u) == warc.url_key(url))
        index.blocks_read, index.held = 0, None
        assert sorted(str(r["page_id"]) for r in index.lookup(url)) == want
        assert index.blocks_read <= 3 + len(want) // 7
    assert index.lookup("http://nowhere.example.com/") == []
    # some captures only: the others' blocks need not be read
    some = warc.request_keys(pages.where("page_id IN (3, 17)"))
    assert sorted(r.page_id for r in warc.read_archives(spark, folder, manifest, some).collect()) == [3, 17]
    # archives are plain gzip members for any reader
    name = next(index.places("com,example,z)/", None))["file"]
    with index.store.open(name) as f:
        assert gzip.GzipFile(fileobj=io.BytesIO(f.read())).read().startswith(b"WARC/1.1")
    empty = new_folder(spark, "test-warc-empty")
    nothing = pages.limit(0)
    assert warc.read_archives(spark, empty, warc.write_index(warc.write_archives(nothing, empty), empty), warc.request_keys(nothing)).count() == 0
