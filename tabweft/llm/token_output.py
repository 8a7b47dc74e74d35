"""Token ids as seekable zstandard files.

A file is a run of independent zstandard frames, each with some whole documents, followed by two skippable frames:
the *directory* (first document of every frame) and, last, a *seek table* in the seekable format of the zstandard
project: for every frame its compressed and decompressed size and the low 32 bits of its XXH64, then the number of
frames, a descriptor and the magic number. A reader takes the two tables from the end of the file, finds the
frame of a document by binary search, and reads, checks and decompresses only that.

Frame payload, little-endian: number of documents u32, width of an id u8; per document: has a doc_id u8, doc_id
i64, number of ids u32; then the ids, unsigned of that width.

Files hold ranges of doc_id in ascending order (null first), so the order of all ids is that of the file names.
Null texts count as empty: one end id. Repeated doc_ids stay separate documents, in any order among themselves.
An empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, materialize, new_folder, open_shared, shuffle_partitions, table, text_bytes
from tabweft.llm.vocabulary import default_path, word_vocabulary

END_ID = 1
#: Bytes of ids after which a frame ends.
FRAME_BYTES = 256 << 10
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, DIRECTORY_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80

_DOCUMENT = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("n", "<u4")])
_ENTRY = np.dtype([("compressed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
_FIRST = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("documents", "<u4"), ("ids", "<u8")])


class FrameWriter:
    """Writes documents in the order given."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.firsts: list[tuple[int, int, int, int]] = []
        self.documents: list[tuple[int, int, int]] = []
        self.ids: list[np.ndarray] = []
        self.held = self.total = self.count = self.frame_start = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id is not None, doc_id or 0, len(ids)))
        self.ids.append(ids)
        self.held += 4 * len(ids)
        self.total += len(ids)
        self.count += 1
        if self.held >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if not self.documents:
            return
        ids = np.concatenate(self.ids)
        width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        heads = np.array(self.documents, _DOCUMENT)
        payload = struct.pack("<IB", len(heads), width) + heads.tobytes() + ids.astype(f"<u{width}").tobytes()
        frame = self.compressor.compress(payload)
        self.out.write(frame)
        self.entries.append((len(frame), len(payload), xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF))
        self.firsts.append((*self.documents[0][:2], len(heads), self.frame_start))
        self.documents, self.ids, self.held, self.frame_start = [], [], 0, self.total

    def close(self) -> None:
        self._frame()
        directory = np.array(self.firsts, _FIRST).tobytes()
        table = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", DIRECTORY_MAGIC, len(directory)) + directory + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Random access by document over a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, io.SEEK_END)
        end = source.tell()
        source.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table = end - 9 - frames * _ENTRY.itemsize
        source.seek(table)
        self.entries = np.frombuffer(source.read(frames * _ENTRY.itemsize), _ENTRY)
        source.seek(table - 8 - frames * _FIRST.itemsize)
        self.firsts = np.frombuffer(source.read(frames * _FIRST.itemsize), _FIRST)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["compressed"], dtype=np.int64)])
        self.decompressor = zstandard.ZstdDecompressor()
        self.frames_read = 0

    def frame(self, n: int) -> list[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the file before it, ids) of the documents in frame ``n``; ValueError if its checksum differs."""
        self.source.seek(int(self.starts[n]))
        entry = self.entries[n]
        payload = self.decompressor.decompress(self.source.read(int(entry["compressed"])), int(entry["size"]))
        self.frames_read += 1
        if xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF != entry["checksum"]:
            raise ValueError(f"frame {n}: checksum differs")
        count, width = struct.unpack_from("<IB", payload)
        heads = np.frombuffer(payload, _DOCUMENT, count, 5)
        ids = np.frombuffer(payload, f"<u{width}", offset=5 + heads.nbytes)
        ends = np.cumsum(heads["n"], dtype=np.int64)
        start = int(self.firsts[n]["ids"])
        return [(int(h["doc_id"]) if h["has_id"] else None, start + int(e - h["n"]), ids[e - h["n"] : e]) for h, e in zip(heads, ends, strict=True)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for n in range(len(self.entries)):
            yield from self.frame(n)

    def lookup(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this doc_id; only frames that can hold it are read."""
        keys = [(bool(f["has_id"]), int(f["doc_id"])) for f in self.firsts]
        first = max(0, bisect_left(keys, (True, doc_id)) - 1)
        last = bisect_right(keys, (True, doc_id))
        return [ids for n in range(first, last) for d, _, ids in self.frame(n) if d == doc_id]


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` and write them below ``folder``. Returns the manifest: file, name, documents, ids; one row per file."""
    path = vocabulary or default_path("word_bpe_49k.json")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    # one file for each range of doc_ids
    dealt = docs.repartitionByRange(shuffle_partitions(docs.sparkSession), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    end = np.array([end_id], np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        words, store = word_vocabulary(path), open_shared(folder)
        rows = ((d, t) for b in batches for d, t in zip(b.column("doc_id").to_pylist(), text_bytes(b), strict=True))
        head = next(rows, None)
        if head is None:
            return
        name = f"tokens-{file:06d}-{os.urandom(4).hex()}.zst"  # of this attempt; the manifest names the one that counts
        made: list[FrameWriter] = []

        def fill(out) -> None:
            writer, row = FrameWriter(out), head
            while row is not None:
                writer.add(row[0], np.concatenate([np.frombuffer(words.encode(row[1]), "<u4"), end]))
                row = next(rows, None)
            writer.close()
            made.append(writer)

        store.write(name, fill)
        yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([name]), pa.array([made[0].count], pa.int64()), pa.array([made[0].total], pa.int64())], names=["file", "name", "documents", "ids"])

    return materialize(arrow_map(dealt, write, "file int, name string, documents long, ids long"), "token-manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = manifest.select("file", "name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = open_shared(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open(name) as f:
                    reader = FrameReader(f)
                    for n in range(len(reader.entries)):
                        rows = [(d, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in reader.frame(n)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(starts.repartition(shuffle_partitions(spark)).select("name", "start"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_seekable_token_files(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(table(spark, sf_dir, "documents"), folder))
