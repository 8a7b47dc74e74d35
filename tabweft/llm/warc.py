"""WARC archives with a two-level capture index.

Writing: pages with equal payloads are found by SHA-1 over (page_id, digest) rows only, the payloads are dealt by
page_id, and every task appends gzip members, one for each record, to archives of its own; the smallest page_id of
a payload becomes ``response``, the others ``revisit`` records without payload that name it.

Index: one line for each capture, ``<reversed-host URL key> <JSON>``, sorted over all tasks by key and page_id. The first
level is files of compressed blocks of ``BLOCK_LINES`` lines; the second, at the end of each file, the sparse
directory of its blocks: first key and page_id, offset and length. A lookup binary-searches the files' first keys (a
row for each file of the index), then the file's directory, reads one block (or as many as the key fills), and
range-reads the records. Many lookups are sorted by key first, so that a task reads each of its blocks once, and their
range reads are dealt and sorted by archive and offset.

Null html counts as an empty payload, a null url gives the empty key. Pages without page_id come after all others.
Rows that repeat both page_id and payload are all responses or all revisits. An empty table gives no archive and an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import itemgetter
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, materialize, new_folder, open_shared, shuffle_partitions, table

BLOCK_LINES = 1000
#: An archive is closed after this many bytes.
ARCHIVE_BYTES = 1 << 30
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
#: Captures of one read task lie within this many bytes of an archive.
READ_BYTES = 32 << 20
CAPTURES = "key string, page_id long, line string"
MANIFEST = "part int, name string, first string, first_id long, blocks long, captures long"
#: The end of an index file: offset and length of its directory.
_TAIL = struct.Struct("<QQI")
_MAGIC = 0x43445832
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Reversed-host key: ``https://www.Example.com:443/a?b`` gives ``com,example,www)/a?b``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.strip()
    if not host:
        return url.strip()
    if port in (None, {"http": 80, "https": 443}.get(parts.scheme)):
        port = ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record as WARC/1.1 text, not compressed; ``refers_to`` makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload; ValueError if it is torn."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    length = int(fields["Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("record cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    number = lambda x: int(x) if (x := x[10:-1]) else None  # noqa: E731  of <urn:page:N>
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != full or digest_of(payload) != digest):
        raise ValueError("payload differs from its digest")
    refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": full, "payload_digest": digest, "record_type": kind, "refers_to": refers, "url": fields["WARC-Target-URI"], "payload": payload}


def references(pages: DataFrame) -> DataFrame:
    """(page_id, sha, refers_to) of the pages whose payload a page with a smaller page_id has; one row for each pair."""
    seen = pages.select(F.col("page_id").cast("long"), _sha().alias("sha"))
    firsts = seen.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    return seen.join(firsts, "sha").where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def _sha():
    return F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives below ``folder``; returns the captures (key, page_id, line), which are files in the shared folder."""
    refs = references(pages).withColumnRenamed("page_id", "ref_id").withColumnRenamed("sha", "ref_sha")
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", _sha().alias("sha"))
    joined = keyed.join(refs, keyed["page_id"].eqNullSafe(refs["ref_id"]) & (keyed["sha"] == refs["ref_sha"]), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = open_shared(folder)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True))
        row = next(rows, None)
        while row is not None:
            name, captures = f"pages-{os.urandom(8).hex()}.warc.gz", []

            def fill(out, name=name, captures=captures) -> None:
                nonlocal row
                at = 0
                while row is not None and at < ARCHIVE_BYTES:
                    page_id, url, html, refers_to = row
                    payload = (html or "").encode()
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, payload, refers_to, digest_of(payload))) + packer.flush()
                    out.write(member)
                    captures.append((url_key(url), page_id, json.dumps({"id": page_id, "file": name, "offset": at, "length": len(member)})))
                    at += len(member)
                    row = next(rows, None)

            store.write(name, fill)
            for k in range(0, len(captures), 10_000):
                keys, ids, lines = zip(*captures[k : k + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(lines, pa.string())], names=["key", "page_id", "line"])

    return materialize(arrow_map(joined, write, CAPTURES), "warc-captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort the captures into files of compressed blocks below ``folder``; returns the manifest, one row per file."""
    n = shuffle_partitions(captures.sparkSession)
    # by key and page_id, so that a URL with many captures is spread over files
    ordered = captures.repartitionByRange(n, "key", F.col("page_id").asc_nulls_first()).sortWithinPartitions("key", F.col("page_id").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, name, directory, count = open_shared(folder), f"index-{part:06d}-{os.urandom(4).hex()}.cdx", [], [0]
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "line")), strict=True))
        head = next(rows, None)
        if head is None:
            return

        def fill(out) -> None:
            at, row = 0, head
            while row is not None:
                first, lines = row, []
                while row is not None and len(lines) < BLOCK_LINES:
                    lines.append(f"{_escape(row[0])} {row[2]}\n")
                    row = next(rows, None)
                member = _packed("".join(lines).encode())
                out.write(member)
                directory.append([first[0], first[1], at, len(member)])
                count[0] += len(lines)
                at += len(member)
            member = _packed(json.dumps(directory).encode())
            out.write(member + _tail(at, len(member)))

        store.write(name, fill)
        values = (part, name, head[0], head[1], len(directory), count[0])
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "name", "first", "first_id", "blocks", "captures"])

    return materialize(arrow_map(ordered, write, MANIFEST), "warc-manifest")


def _tail(at: int, length: int) -> bytes:
    return _TAIL.pack(at, length, _MAGIC)


def _packed(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _escape(key: str) -> str:
    """Keys have no space or line end in a line of the index."""
    return key.replace("%", "%25").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") if any(c in key for c in "% \n\r") else key


def _unescape(key: str) -> str:
    return key.replace("%0D", "\r").replace("%0A", "\n").replace("%20", " ").replace("%25", "%") if "%" in key else key


def _block(store, name: str, offset: int, length: int) -> list[tuple[str, dict]]:
    with store.open(name) as f:
        f.seek(offset)
        text = zlib.decompress(f.read(length), 31).decode()
    return [(_unescape(key), json.loads(line)) for key, _, line in (x.partition(" ") for x in text.split("\n")[:-1])]


def _read(store, at: dict) -> dict:
    with store.open(at["file"]) as f:
        f.seek(at["offset"])
        return parse(zlib.decompress(f.read(at["length"]), 31))


def _order(page_id: int | None) -> tuple[bool, int]:
    return page_id is not None, page_id or 0


class CaptureIndex:
    """Lookups by binary search. ``files``: (first key, first page_id, name) of every index file, in order; one block is kept."""

    def __init__(self, folder: str, files: list[tuple[str, int | None, str]]):
        self.store, self.files = open_shared(folder), files
        self.file_keys = [(key, *_order(i)) for key, i, _ in files]
        self.directories: dict[str, tuple[list, list]] = {}
        self.held: tuple[tuple, list] | None = None
        self.blocks_read = 0

    @classmethod
    def of(cls, folder: str, manifest: DataFrame) -> CaptureIndex:
        return cls(folder, index_files(manifest))

    def directory(self, name: str) -> tuple[list, list]:
        """(keys, [key, page_id, offset, length]) of a file's blocks; read once, the last file's is kept."""
        if name not in self.directories:
            with self.store.open(name) as f:
                f.seek(0, os.SEEK_END)
                end = f.tell() - _TAIL.size
                f.seek(end)
                at, length, magic = _TAIL.unpack(f.read(_TAIL.size))
                if magic != _MAGIC:
                    raise ValueError(f"{name} is no index file")
                f.seek(at)
                rows = json.loads(zlib.decompress(f.read(length), 31))
            self.directories = {name: ([(key, *_order(i)) for key, i, _, _ in rows], rows)}
        return self.directories[name]

    def block(self, name: str, offset: int, length: int) -> list[tuple[str, dict]]:
        if self.held is None or self.held[0] != (name, offset):
            self.held = (name, offset), _block(self.store, name, offset, length)
            self.blocks_read += 1
        return self.held[1]

    def places(self, key: str, page_id: int | None = None, any_id: bool = False) -> Iterator[dict]:
        """Where the captures of a key and page_id (or of all its page_ids) lie: id, file, offset, length."""
        low = (key,) if any_id else (key, *_order(page_id))
        past = lambda first: first[: len(low)] > low
        at = max(0, bisect_left(self.file_keys, low) - 1)
        while at < len(self.files) and not past(self.file_keys[at]):
            name = self.files[at][2]
            firsts, rows = self.directory(name)
            n = max(0, bisect_left(firsts, low) - 1)
            while n < len(rows) and not past(firsts[n]):
                lines = self.block(name, *rows[n][2:])
                for k in range(bisect_left(lines, key, key=itemgetter(0)), bisect_right(lines, key, key=itemgetter(0))):
                    if any_id or lines[k][1]["id"] == page_id:
                        yield lines[k][1]
                n += 1
            at += 1

    def lookup(self, url: str) -> list[dict]:
        """All captures of a URL as fields of their records."""
        return [_read(self.store, where) for where in self.places(url_key(url), any_id=True)]


def index_files(manifest: DataFrame) -> list[tuple[str, int | None, str]]:
    """(first key, first page_id, name) of every index file, in order: a row for each shuffle partition at most."""
    return [(r["first"], r["first_id"], r["name"]) for r in manifest.orderBy("part").collect()]


def request_keys(pages: DataFrame) -> DataFrame:
    """(key, page_id) of the pages, each pair once: what :func:`read_archives` looks up."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["page_id"]).append_column("key", pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()))

    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")), keys, "page_id long, key string").distinct()


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, requests: DataFrame) -> DataFrame:
    """The captures of the requests (key, page_id), found in the index and read from their archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    n, files = shuffle_partitions(spark), index_files(manifest)

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, files)
        for batch in batches:
            where = [w for key, i in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True) for w in index.places(key, i)]
            yield pa.RecordBatch.from_arrays([pa.array([w[c] for w in where], k) for c, k in (("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))], names=["file", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name, source = open_shared(folder), None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if source:
                        source.close()
                    name, source = file, store.open(file)
                source.seek(offset)
                out.append(parse(zlib.decompress(source.read(length), 31)))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in zip(names, kinds, strict=True)], names=names)
        if source:
            source.close()

    asked = requests.select("key", "page_id").repartitionByRange(n, "key", F.col("page_id").asc_nulls_first()).sortWithinPartitions("key", F.col("page_id").asc_nulls_first())
    lines = arrow_map(asked, captures, "file string, offset long, length long")
    dealt = lines.withColumn("span", F.floor(F.col("offset") / READ_BYTES)).repartition(n, "file", "span").sortWithinPartitions("file", "offset")
    return arrow_map(dealt.select("file", "offset", "length"), read, RECORDS)


def op6_warc_archives(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    manifest = write_index(write_archives(pages, folder), folder)
    return read_archives(spark, folder, manifest, request_keys(pages))


def oracle_sql() -> str:
    part = "('0x' || substr(h, {0}, 5))::INT"  # 20 bits of the digest, four letters
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({0} >> {1}) & 31) + 1, 1)"
    digest = " || ".join(letter.format(part.format(at), shift) for at in range(1, 41, 5) for shift in (15, 10, 5, 0))
    return f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes, {digest} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
    """
