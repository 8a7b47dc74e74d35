"""Quality rules: per-document counts, then cross-document line frequency.

Base rules: a document fails with fewer than ``MIN_WORDS`` words, or when more than ``MAX_REPEAT_PERCENT`` % of
its words lie in 8-word windows that occur twice or more in it.

Line rules: every normalised line (ASCII lower case, single spaces) is hashed, and the distinct documents that
hold it are counted per host (``source``). A line in more than ``max(min_docs, share * documents of the host)``
documents is boilerplate and is removed; a document that keeps fewer than ``MIN_WORDS`` words or less than
``MIN_LEFT_PERCENT`` % of them is depleted and rejected. Documents are told apart by a hash of their whole text
(its normalised lines), in the count of a line and in that of the host. Exact copies thus count as one document: a
large group of them does not make its own lines look like boilerplate.

Null or empty texts have no words and fail. Null hosts are one host. Repeated rows are judged alike. Empty
tables give empty results; other columns are ignored, and kept by :func:`apply_rules`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, materialize, table, text_bytes, unused, with_rows

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A line is boilerplate above this many documents of a host ...
MIN_DOCS = 50
#: ... and above this share of the host's documents.
SHARE = 0.1
MIN_LEFT_PERCENT = 30

_WS = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
#: All bytes that begin a code point.
_CONTINUATION_ONLY = bytes(range(0x80)) + bytes(range(0xC0, 0x100))
_ODD = (np.random.default_rng(9).integers(1, 1 << 63, WINDOW, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
STATS = (
    "doc_id long, row_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, text_key long, lines array<long>, line_words array<int>"
)


def normalise_line(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(normalise_line(line)) - (1 << 63)


def repeat_words(hashes: np.ndarray) -> int:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = hashes[:n] * _ODD[0]
        for j in range(1, WINDOW):
            h += hashes[j : j + n] * _ODD[j]
    ordered = np.sort(h)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    at = np.flatnonzero(np.isin(h, ordered[1:][same]))
    cover = np.zeros(len(hashes) + 1, np.int32)
    cover[at] += 1
    cover[at + WINDOW] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def document_stats(text: bytes) -> tuple[int, int, int, int, int, int, list[int], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hash of the whole text, distinct line hashes, words of each)."""
    n, dense = 0, text.translate(None, _WS)
    words: list[bytes] = []
    seen, dups, lines, counts, whole = set(), 0, {}, [], xxhash.xxh3_64()
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        if line in seen:
            dups += 1
        else:
            seen.add(line)
        plain = b" ".join(own).lower()
        whole.update(plain + b"\n")
        at = lines.setdefault(xxhash.xxh3_64_intdigest(plain) - (1 << 63), len(lines))
        if at == len(counts):
            counts.append(0)
        counts[at] += len(own)
        words += own
        n += len(own)
    chars = len(dense) - len(dense.translate(None, _CONTINUATION_ONLY))
    symbols = len(dense) - len(dense.translate(None, _SYMBOLS))
    if not n:
        return 0, 0, symbols, 0, 0, 0, [], []
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    return n, chars, symbols, dups, repeat_words(hashes), whole.intdigest() - (1 << 63), list(lines), counts


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = list(zip(*map(document_stats, text_bytes(batch)), strict=True))
        arrays = [batch.column("doc_id"), batch.column("row_id"), batch.column("source"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_key", "lines", "line_words"])


def _narrow(docs: DataFrame, row: str | None) -> DataFrame:
    row_id = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(F.col("doc_id").cast("long"), row_id.alias("row_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")


def measure(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row per document: row_id (of column ``row``, or a number of its own), its counts, its key and its distinct lines."""
    return materialize(arrow_map(_narrow(docs, row), _stats, STATS), "quality-stats")


def frequent_lines(stats: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(source, line, n_docs) of the lines above their host's limit."""
    told = stats.select("source", "text_key", F.explode("lines").alias("line")).distinct()
    hosts = stats.select("source", "text_key").distinct().groupBy("source").agg(F.count("*").alias("host_docs"))
    counted = told.groupBy("source", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    return counted.join(hosts, "source").where(F.col("n_docs") > share * F.col("host_docs")).select("source", "line", "n_docs")


def removed_lines(stats: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row_id, removed_words, removed) of the documents that hold boilerplate."""
    held = stats.select("row_id", "source", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row_id", "source", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    hit = held.join(frequent.select("source", "line"), ["source", "line"])
    return hit.groupBy("row_id").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed"))


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, removed_words, removed (line hashes)."""
    return _verdicts(docs, min_docs, share).drop("row_id")


def _verdicts(docs: DataFrame, min_docs: int, share: float, row: str | None = None) -> DataFrame:
    """:func:`judge` with row_id, the value of column ``row``."""
    stats = measure(docs, row)
    removed = removed_lines(stats, frequent_lines(stats, min_docs, share))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    depleted = F.col("removed_words").isNotNull() & ((left < MIN_WORDS) | (100 * left < MIN_LEFT_PERCENT * F.col("n_words")))
    return (
        stats.drop("lines", "line_words", "text_key", "source").join(removed, "row_id", "left")
        .select("doc_id", "row_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.coalesce("removed_words", F.lit(0)).alias("removed_words"), "removed")
    )


def _strip(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist(), strict=True):
                if gone:
                    gone = set(gone)
                    lines = text.encode().split(b"\n")
                    text = b"\n".join(x for x in lines if not x.split() or line_hash(x) not in gone).decode()
                out.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(out, batch.schema.field("text").type)).drop_columns([column])

    return run


def apply_rules(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, without_id: bool = False) -> DataFrame:
    """The documents that pass, without their boilerplate lines; columns as in ``docs``.

    Every row is judged by itself, also where several share a doc_id. Rows without doc_id go, unless ``without_id``.
    """
    keyed, row = with_rows(docs, "quality-rows")
    gone = unused(keyed, "__gone")
    passed = _verdicts(keyed, min_docs, share, row).where("kept")
    if not without_id:
        passed = passed.where("doc_id IS NOT NULL")
    joined = keyed.join(passed.select(F.col("row_id").alias(row), F.col("removed").alias(gone)), row).drop(row)
    return arrow_map(joined, _strip(gone), docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("removed", "removed_words")
