"""Exact deduplication through an extendible-hash index on shared files.

1. Every task folds the copies that it meets itself: one *entry* per distinct normalised text of the task.
   Only entries carry text; a text that a third of all rows share becomes one entry per task and ``FOLD_BYTES``.
2. Entries go to owner tasks by ranges of the 64-bit key (its top bits), unsorted within a range. An owner inserts
   them into an :class:`ExtendibleHash`, one for each range: the directory leads to a bucket, the bucket to the chain
   of the key, and the text is compared byte by byte with those of the chain. An overfull bucket is split, and the
   directory doubles when a split needs more bits. Buckets beyond ``CACHE_BYTES`` are written out and read again when
   a key leads to them.
3. An index file in the shared folder holds the buckets of a range as pages, then its directory; it can be opened
   again (:func:`open_index`), searched by reading one page, and grown. Group sizes, digests and the rows that stay
   are read from the pages of these files, and documents meet their group through the entry's number, an even join.

Null texts count as empty; all empty texts form one group. Repeated doc_ids stay separate rows. Empty tables
give empty results. Other columns are not read by :func:`exact_classes` and are kept by :func:`drop_copies`.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.cluster import clear, made
from tabweft.llm.common import arrow_map, materialize, new_folder, open_shared, shuffle_partitions, table, text_bytes, with_rows

#: Bytes of text that a task holds before it hands its entries on; copies on both sides of it meet in the index.
FOLD_BYTES = 24 << 20
#: Keys of a bucket before it is split.
BUCKET_KEYS = 256
#: Directory bits at most; keys that agree in all of them share a bucket and chain there.
MAX_DEPTH = 24
#: Bytes of a bucket that is split, as far as its keys differ.
BUCKET_BYTES = 4 << 20
#: Bytes of buckets that an owner holds in memory.
CACHE_BYTES = 32 << 20
#: Bytes of texts of one range, so that no index file grows with the table.
RANGE_BYTES = 256 << 20
#: Key ranges for each shuffle partition: many small ranges even out.
RANGES_PER_PARTITION = 4

_SPACES = b" \t\n\r\x0b\x0c"
#: Task number and place in the task, in one number.
_TASK_BITS = 36
_MAGIC = 0x45484958
#: A page of an index file: offset, length, depth of its bucket; and the file's end: pages, keys, depth, skipped bits, offset of the pages' table.
_PAGE, _TAIL = struct.Struct("<QQB"), struct.Struct("<QQBBQI")
FOLDED = "doc_id long, row_id long, entry_id long, key long, lead boolean, members long, size long, text binary"
MANIFEST = "range long, name string, depth int, pages long, keys long"
INDEX = "entry_id long, keep_id long, first_entry boolean, group_size long, text_sha256 string"


def _by_id(doc_id: int | None) -> tuple[bool, int]:
    """Order of doc_ids; null comes last."""
    return doc_id is None, doc_id or 0


def normalise(text: bytes) -> bytes:
    """Every run of ASCII white space becomes one space."""
    if not text:
        return text
    words = text.split()
    if not words:
        return b" "
    head = b" " if text[:1] in _SPACES else b""
    tail = b" " if text[-1:] in _SPACES else b""
    return head + b" ".join(words) + tail


class Bucket:
    """key -> chain of [text, entries]; an entry is (doc_id, entry_id, members)."""

    _HEAD, _NODE, _ENTRY = struct.Struct("<QI"), struct.Struct("<QI"), struct.Struct("<BqQQ")

    def __init__(self, depth: int):
        self.depth, self.chains, self.bytes = depth, {}, 0

    def add(self, key: int, text: bytes, entries: list[tuple[int | None, int, int]]) -> None:
        """Find ``text`` in the key's chain by comparing bytes; it becomes the end of the chain if it is not there."""
        chain = self.chains.setdefault(key, [])
        for known, own in chain:
            if known == text:
                own += entries
                break
        else:
            chain.append([text, list(entries)])
            self.bytes += len(text) + 200
        self.bytes += 120 * len(entries)

    def pack(self) -> bytes:
        out = [struct.pack("<I", len(self.chains))]
        for key, chain in self.chains.items():
            out.append(self._HEAD.pack(key, len(chain)))
            for text, entries in chain:
                out.append(self._NODE.pack(len(text), len(entries)))
                out.append(text)
                out += [self._ENTRY.pack(d is not None, d or 0, e, n) for d, e, n in entries]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(out))

    @classmethod
    def unpack(cls, depth: int, raw: bytes) -> Bucket:
        raw, out, at = zstandard.ZstdDecompressor().decompress(raw), cls(depth), 4
        for _ in range(struct.unpack_from("<I", raw)[0]):
            key, nodes = cls._HEAD.unpack_from(raw, at)
            at += cls._HEAD.size
            for _ in range(nodes):
                size, count = cls._NODE.unpack_from(raw, at)
                at += cls._NODE.size
                text = raw[at : at + size]
                at += size
                entries = [(d if has else None, e, n) for has, d, e, n in cls._ENTRY.iter_unpack(raw[at : at + count * cls._ENTRY.size])]
                at += count * cls._ENTRY.size
                out.add(key, text, entries)
        return out


class ExtendibleHash:
    """Directory of 2**depth slots over the top bits of a key; buckets split alone, the directory doubles.

    A slot holds a bucket's number. Buckets in memory beyond ``cache_bytes`` are written to files of ``store`` and come
    back when a key leads to them.
    """

    def __init__(self, store=None, name: str = "index", capacity: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH, skip_bits: int = 0, cache_bytes: int = CACHE_BYTES, bucket_bytes: int = BUCKET_BYTES):
        self.store, self.name, self.capacity, self.max_depth, self.skip, self.cache_bytes, self.bucket_bytes = store, name, capacity, max_depth, skip_bits, cache_bytes, bucket_bytes
        self.depth = 0
        self.directory = [0]
        self.depths = [0]  # of every bucket
        self.held: OrderedDict[int, Bucket] = OrderedDict({0: Bucket(0)})  # the least recently used first
        self.places: dict[int, tuple[str, int, int]] = {}  # of buckets that are not held: file, offset, length
        self.spilled: set[str] = set()
        self.spills = 0
        self.bytes = self.pages_read = self.keys = 0

    def slot(self, key: int, depth: int) -> int:
        return ((key << self.skip) & 0xFFFFFFFFFFFFFFFF) >> (64 - depth) if depth else 0

    def bucket(self, number: int) -> Bucket:
        if number not in self.held:
            name, offset, length = self.places[number]  # it stays there, for as long as the bucket does not change
            with self.store.open(name) as f:
                f.seek(offset)
                self.held[number] = Bucket.unpack(self.depths[number], f.read(length))
            self.pages_read += 1
            self.bytes += self.held[number].bytes
        self.held.move_to_end(number)
        return self.held[number]

    def insert(self, key: int, text: bytes, entries: list[tuple[int | None, int, int]]) -> None:
        while True:
            number = self.directory[self.slot(key, self.depth)]
            bucket = self.bucket(number)
            others = len(bucket.chains) - (key in bucket.chains)
            full = key not in bucket.chains and others >= self.capacity or others and bucket.bytes + len(text) > self.bucket_bytes
            if not full or bucket.depth >= self.max_depth:
                break
            self._split(key, number)
        self._forget(number)
        before = bucket.bytes
        self.keys += key not in bucket.chains
        bucket.add(key, text, entries)
        self.bytes += bucket.bytes - before
        while self.store is not None and self.bytes > self.cache_bytes and len(self.held) > 1:
            self._spill()

    def find(self, key: int, text: bytes) -> list[tuple[int | None, int, int]]:
        """The entries of a text; none if it is not there. Reads one bucket at most."""
        chain = self.bucket(self.directory[self.slot(key, self.depth)]).chains.get(key, [])
        return next((entries for known, entries in chain if known == text), [])

    def _forget(self, number: int) -> None:
        """The bucket has changed: what was written of it is void."""
        name, _, _ = self.places.pop(number, ("", 0, 0))
        if name in self.spilled:
            self.spilled.remove(name)
            self.store.remove(name)

    def _split(self, key: int, number: int) -> None:
        self._forget(number)
        old = self.held.pop(number)
        if old.depth == self.depth:  # the directory doubles: every slot twice
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth += 1
        local, other = old.depth + 1, len(self.depths)
        halves = Bucket(local), Bucket(local)
        for k, chain in old.chains.items():
            for text, entries in chain:
                halves[self.slot(k, local) & 1].add(k, text, entries)
        self.depths[number] = local
        self.depths.append(local)
        self.held[number], self.held[other] = halves
        self.bytes += halves[0].bytes + halves[1].bytes - old.bytes
        width = 1 << (self.depth - local)
        first = (self.slot(key, self.depth) >> (self.depth - local + 1)) << (self.depth - local + 1)
        self.directory[first + width : first + 2 * width] = [other] * width

    def _spill(self) -> None:
        number, bucket = self.held.popitem(last=False)
        self.bytes -= bucket.bytes
        if number in self.places:  # unchanged
            return
        name, raw = f"{self.name}.{number}.{self.spills}", bucket.pack()
        self.store.write(name, lambda f: f.write(raw))
        self.spilled.add(name)
        self.spills += 1
        self.places[number] = (name, 0, len(raw))

    def save(self) -> None:
        """Write all buckets as pages, then the directory, into one file; what was spilled is deleted."""

        def fill(out) -> None:
            at, pages = 0, []
            for number, depth in enumerate(self.depths):
                if number in self.held:
                    raw = self.held[number].pack()
                else:
                    name, offset, length = self.places[number]
                    with self.store.open(name) as f:
                        f.seek(offset)
                        raw = f.read(length)
                out.write(raw)
                pages.append(_PAGE.pack(at, len(raw), depth))
                moved[number] = (self.name, at, len(raw))
                at += len(raw)
            out.write(b"".join(pages) + struct.pack(f"<{len(self.directory)}Q", *self.directory))
            out.write(_TAIL.pack(len(pages), self.keys, self.depth, self.skip, at, _MAGIC))

        moved: dict[int, tuple[str, int, int]] = {}
        self.store.write(self.name, fill)
        self.places = moved
        for name in self.spilled:
            self.store.remove(name)
        self.spilled = set()

    def buckets(self) -> Iterator[Bucket]:
        """Every bucket once, one at a time; those that were not held are not kept."""
        for number in range(len(self.depths)):
            there = number in self.held
            yield self.bucket(number)
            if not there:
                self.bytes -= self.held.pop(number).bytes


def open_index(store, name: str, new_name: str | None = None, **options) -> ExtendibleHash:
    """An index file as it was saved, its pages still on disk. ``new_name``: where :meth:`ExtendibleHash.save` puts it after it has grown."""
    with store.open(name) as f:
        f.seek(0, os.SEEK_END)
        end = f.tell() - _TAIL.size
        f.seek(end)
        pages, keys, depth, skip, at, magic = _TAIL.unpack(f.read(_TAIL.size))
        if magic != _MAGIC:
            raise ValueError(f"{name} is no index file")
        f.seek(at)
        raw = f.read(end - at)
    out = ExtendibleHash(store, new_name or name, skip_bits=skip, **options)
    rows = list(_PAGE.iter_unpack(raw[: _PAGE.size * pages]))
    out.depth, out.depths, out.held, out.keys = depth, [d for _, _, d in rows], OrderedDict(), keys
    out.places = {n: (name, offset, length) for n, (offset, length, _) in enumerate(rows)}
    out.directory = list(struct.unpack(f"<{1 << depth}Q", raw[_PAGE.size * pages :]))
    return out


def key_of(text: bytes) -> int:
    """The 64-bit key of a normalised text."""
    return xxhash.xxh3_64_intdigest(text)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held: dict[bytes, list] = {}  # normalised text -> doc_ids
    size, entry = 0, TaskContext.get().partitionId() << _TASK_BITS

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal entry
        cols: list[list] = [[] for _ in range(8)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        names, some = ["doc_id", "row_id", "entry_id", "key", "lead", "members", "size", "text"], 0
        while held:
            text, members = held.popitem()
            n, lead = len(members), members.index(min(members, key=lambda m: _by_id(m[0])))
            key = key_of(text) - (1 << 63)
            for at, (doc_id, row_id) in enumerate(members):
                own = at == lead
                for c, v in zip(cols, (doc_id, row_id, entry, key, own, n if own else None, len(text) if own else None, text if own else None), strict=True):
                    c.append(v)
            entry += 1
            some += len(text) + 50 * n
            if some > 4 << 20 or not held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
                cols, some = [[] for _ in range(8)], 0

    for batch in batches:
        for doc_id, row_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("row_id").to_pylist(), text_bytes(batch), strict=True):
            text = normalise(raw)
            members = held.get(text)
            if members is None:
                held[text] = [(doc_id, row_id)]
                size += len(text) + 100
            else:
                members.append((doc_id, row_id))
                size += 16
        if size > FOLD_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def _owner(folder: str, bits: int):
    """The owner task: entries arrive range by range; each range becomes an index file of this attempt, named in the manifest."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, index, of_range = open_shared(folder), None, None

        def saved() -> pa.RecordBatch:
            index.save()
            values = (of_range, index.name, index.depth, len(index.depths), index.keys)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["range", "name", "depth", "pages", "keys"])

        for batch in batches:
            for r, key, doc_id, entry, n, text in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "doc_id", "entry_id", "members", "text")), strict=True):
                if r != of_range:
                    if index is not None:
                        yield saved()
                    of_range = r
                    index = ExtendibleHash(store, f"range-{r:08d}-{os.urandom(4).hex()}", skip_bits=bits)
                index.insert(key + (1 << 63), text, [(doc_id, entry, n)])
        if index is not None:
            yield saved()

    return own


def build_index(docs: DataFrame, folder: str, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_id, entry_id, lead) of every document, and the manifest of the index files below ``folder``."""
    row_id = F.col(row) if row else F.lit(0).cast("long")
    folded = materialize(arrow_map(docs.select(F.col("doc_id").cast("long"), row_id.alias("row_id"), "text"), _fold, FOLDED), "exact-entries")
    parts = shuffle_partitions(docs.sparkSession)
    total = folded.agg(F.sum("size")).first()[0] or 0
    ranges = max(parts * RANGES_PER_PARTITION, -(-total // RANGE_BYTES))
    bits = max(4, (ranges - 1).bit_length())
    entries = folded.where("lead").withColumn("range", F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits))
    owned = entries.select("range", "key", "doc_id", "entry_id", "members", "text").repartitionById(parts, F.pmod("range", F.lit(parts)).cast("int")).sortWithinPartitions("range", "key")  # by key, so that a bucket that is left is not touched again
    manifest = materialize(arrow_map(owned, _owner(folder, bits), MANIFEST), "exact-manifest")
    return folded.select("doc_id", "row_id", "entry_id", "lead"), manifest


def read_index(folder: str, manifest: DataFrame) -> DataFrame:
    """The groups of all index files by entry: entry_id, keep_id, first_entry, group_size, text_sha256."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
    names = ["entry_id", "keep_id", "first_entry", "group_size", "text_sha256"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = open_shared(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                for bucket in open_index(store, name).buckets():
                    cols: list[list] = [[] for _ in names]
                    for chain in bucket.chains.values():
                        for text, entries in chain:
                            keep_id, first, _ = min(entries, key=lambda e: (_by_id(e[0]), e[1]))
                            total, sha = sum(n for _, _, n in entries), hashlib.sha256(text).hexdigest()
                            for _, entry, _ in entries:
                                for c, v in zip(cols, (entry, keep_id, entry == first, total, sha), strict=True):
                                    c.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return arrow_map(manifest.select("name").repartition(shuffle_partitions(manifest.sparkSession)), read, INDEX)


def exact_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``kept`` holds for exactly one row of a group, the one with the smallest doc_id (null last).
    """
    return _rows(docs).drop("row_id")


def _rows(docs: DataFrame, row: str | None = None) -> DataFrame:
    """:func:`exact_classes` with row_id, the value of column ``row``."""
    folder = new_folder(docs.sparkSession, "exact-index")
    members, manifest = build_index(docs, folder, row)
    # the manifest's size says nothing about the rows read from its files
    joined = members.join(read_index(folder, manifest).hint("merge"), "entry_id")
    return joined.select("doc_id", "row_id", "keep_id", "group_size", (F.col("lead") & F.col("first_entry")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without exact copies; of each group the row with the smallest doc_id stays, with all its columns.

    Exactly one row of a group stays, also of rows that repeat both doc_id and text or have no doc_id.
    """
    keyed, row = with_rows(docs, "exact-rows")
    before = set(made())
    kept = materialize(_rows(keyed, row).where("kept").select(F.col("row_id").alias(row)), "exact-kept")
    own = [x for x in made() if x not in before and "tabweft-exact-kept-" not in x]
    clear(docs.sparkSession, own)  # entries and index hold the texts again, and are read no more
    return keyed.join(kept, row, "left_semi").select(docs.columns)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    norm = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
    return f"""
        WITH n AS (SELECT doc_id, sha256({norm}) AS h, {norm} AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, h AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """
