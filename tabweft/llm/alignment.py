"""Alignment of two tokenizations of the same texts by byte-owner arrays.

A is a byte-level vocabulary, B one of pieces with a mark for the space and byte fallback; both read space + text. Every byte
has an owner in A and one in B: ``np.repeat`` of the token numbers over the tokens' byte lengths. Consecutive distinct
pairs of owners are the overlaps of tokens; where both owners change at once is a cut, and cuts split the text into
groups. At each cut one token of A and one of B end together: a link.

Both vocabularies encode parts between spaces independently (:mod:`tabweft.llm.parts`), so groups never cross the start
of a part: new parts are aligned many at a time, and a text's result is put together from its parts. Texts for
which that does not hold are aligned whole.

Corpus-wide counts of linked id pairs are summed in every task, then by Spark. The pairs that occur most, at most
``HOT_PAIRS`` of them, are handed to the tasks as two arrays; all other pairs, each of them rare, meet their documents in a
join. Which way a pair takes does not change the result.

Texts that are null, empty, or not given back by either tokenization have no tokens: zeros and an empty ``groups_sha256``.
Repeated rows count each; doc_ids may be null or repeated; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, materialize, table, text_bytes
from tabweft.llm.parts import Remembered, byte_vocabulary, odd, runs_of
from tabweft.llm.vocabulary import default_path

#: Pairs that are handed to every task: 24 bytes each, 24 MB at most.
HOT_PAIRS = 1 << 20
#: Links that a task gathers before it sums them.
SUM_LINKS = 1 << 21
#: Parts remembered in one of two generations; a value takes about 400 bytes.
PARTS = 100_000
_MARK = "▁".encode()
ROWS = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
PAIRS = "pair long, n long"
SCORES = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pair long, n long"


class PieceVocabulary:
    """A vocabulary of the sentencepiece library whose pieces hold the mark of the space at their start only."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.token_bytes = [self._bytes(p) for p in pieces]
        self.lengths = np.fromiter(map(len, self.token_bytes), np.int64, len(pieces))
        self.spaced = np.fromiter((p.startswith("▁") for p in pieces), bool, len(pieces))
        #: Whether parts are independent: no piece reaches over the start of a part, and the library adds one space and changes nothing.
        self.by_part = not any("▁" in p.lstrip("▁") for p in pieces) and self.library.decode(self.library.encode(" a  ﬁ É")) == " a  ﬁ É"

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def ids(self, text: bytes) -> np.ndarray:
        """Ids of a text; the library puts a space before it."""
        return np.array(self.library.encode(text.decode(), num_threads=1), np.uint32)


def owners(lengths: np.ndarray) -> np.ndarray:
    """The token that each byte belongs to."""
    return np.repeat(np.arange(len(lengths)), lengths)


def cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The last byte of every group, of two owner arrays of equal length."""
    both = (a[1:] != a[:-1]) & (b[1:] != b[:-1])
    return np.append(np.flatnonzero(both), len(a) - 1) if len(a) else np.zeros(0, np.int64)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of tokens that share a byte, in order."""
    if not len(a):
        return a, b
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return a[new], b[new]


class Aligner:
    """Alignment of texts; a text's value is (tokens of A, tokens of B, groups, groups as text, pairs as uint64 bytes)."""

    EMPTY = (0, 0, 0, b"", b"")

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_vocabulary(path_a, plain=True), PieceVocabulary(path_b)
        self.known = Remembered(self._align_parts, PARTS)
        self.digits = [b"%d" % i for i in range(max(len(self.a.token_bytes), len(self.b.token_bytes)))]

    def tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of space + text by A and by B, None if either does not give its bytes back."""
        a, b = self.a.ids(b" " + text), self.b.ids(text)
        whole = b" " + text
        if any(b"".join(map(v.token_bytes.__getitem__, ids.tolist())) != whole for v, ids in ((self.a, a), (self.b, b))):
            return None
        return a, b

    def _value(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple:
        """The value of ids with the last token of each group."""
        digits, a_ids, b_ids = self.digits, a.tolist(), b.tolist()
        groups, i, j = [], 0, 0
        for u, v in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            groups.append(b",".join([digits[x] for x in a_ids[i:u]]) + b"|" + b",".join([digits[x] for x in b_ids[j:v]]))
            i, j = u, v
        pairs = (a[last_a].astype(np.uint64) << np.uint64(32)) | b[last_b]
        return len(a), len(b), len(groups), b";".join(groups), pairs.tobytes()

    def align(self, text: bytes) -> tuple:
        """The value of one whole text."""
        found = self.tokens(text) if text else None
        if found is None:
            return self.EMPTY
        a, b = found
        own_a, own_b = owners(self.a.lengths[a]), owners(self.b.lengths[b])
        ends = cuts(own_a, own_b)
        return self._value(a, b, own_a[ends], own_b[ends])

    def _align_parts(self, parts: list[bytes]) -> list[tuple | None]:
        """Values of parts, aligned in a row; None where a tokenization does not give a part's bytes back."""
        joined = b" ".join(parts)
        found = self.tokens(joined)
        if found is not None:
            a, b = found
            starts_a, starts_b = (np.flatnonzero(v.spaced[ids]) for v, ids in ((self.a, a), (self.b, b)))
        if found is None or len(starts_a) != len(parts) or len(starts_b) != len(parts):
            if len(parts) == 1:
                return [None if found is None else self.align(parts[0])]
            half = len(parts) // 2
            return self._align_parts(parts[:half]) + self._align_parts(parts[half:])
        own_a, own_b = owners(self.a.lengths[a]), owners(self.b.lengths[b])
        ends = cuts(own_a, own_b)
        last_a, last_b = own_a[ends], own_b[ends]  # of each group
        first = np.searchsorted(last_a, starts_a).tolist() + [len(ends)]  # group of each part: the part's start is a cut
        bounds_a, bounds_b = [*starts_a.tolist(), len(a)], [*starts_b.tolist(), len(b)]
        digits_a, digits_b = ([self.digits[i] for i in ids.tolist()] for ids in (a, b))
        groups, i, j = [], 0, 0
        for u, v in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            groups.append((digits_a[i] if u == i + 1 else b",".join(digits_a[i:u])) + b"|" + (digits_b[j] if v == j + 1 else b",".join(digits_b[j:v])))
            i, j = u, v
        pairs = ((a[last_a].astype(np.uint64) << np.uint64(32)) | b[last_b]).tobytes()
        return [
            (bounds_a[k + 1] - bounds_a[k], bounds_b[k + 1] - bounds_b[k], y - x, b";".join(groups[x:y]), pairs[8 * x : 8 * y])
            for k, (x, y) in enumerate(zip(first, first[1:], strict=False))
        ]

    def align_all(self, texts: list[bytes]) -> Iterator[tuple]:
        split = [t.split(b" ") if t and self.b.by_part and not odd(b" " + t) and _MARK not in t else None for t in texts]
        known = self.known.hold(set(chain.from_iterable(s for s in split if s)))
        for text, parts in zip(texts, split, strict=True):
            values = [known[p] for p in parts] if parts else []
            if not values or None in values:
                yield self.align(text)
            else:
                n_a, n_b, n, groups, pairs = zip(*values, strict=True)
                yield sum(n_a), sum(n_b), sum(n), b";".join(groups), b"".join(pairs)


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, loaded once per worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or default_path("byte_bpe_50k.json"), b or default_path("piece_bpe_32k.model")


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per document: doc_id, groups (first byte, end, A ids, B ids) and overlaps (A and B token numbers) of space + text."""
    paths = _paths(a, b)
    group = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in batches:
            for at, texts in runs_of(text_bytes(batch)):
                groups, shared = [], []
                for text in texts:
                    found = own.tokens(text) if text else None
                    ids_a, ids_b = found if found else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
                    own_a, own_b = owners(own.a.lengths[ids_a]), owners(own.b.lengths[ids_b])
                    ends = cuts(own_a, own_b)
                    rows, start, i, j = [], 0, 0, 0
                    for end, u, v in zip((ends + 1).tolist(), (own_a[ends] + 1).tolist(), (own_b[ends] + 1).tolist(), strict=True):
                        rows.append({"start": start, "end": end, "a": ids_a[i:u].tolist(), "b": ids_b[j:v].tolist()})
                        start, i, j = end, u, v
                    groups.append(rows)
                    shared.append([{"a": x, "b": y} for x, y in zip(*(z.tolist() for z in overlaps(own_a, own_b)), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(groups, pa.list_(group)), pa.array(shared, pa.list_(pair))], names=["doc_id", "groups", "overlaps"])

    schema = "doc_id long, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>, overlaps array<struct<a: long, b: long>>"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def _rows(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """ROWS: sizes of every document's alignment, and how often it holds each linked pair (sorted, as little-endian arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in batches:
            for at, texts in runs_of(text_bytes(batch)):
                cols: list[list] = [[] for _ in range(7)]
                for n_a, n_b, n, groups, raw in own.align_all(texts):
                    pairs, times = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                    sha = hashlib.sha256(groups).hexdigest() if n else ""
                    for c, v in zip(cols, (n_a, n_b, n, len(raw) // 8, sha, pairs.astype("<u8").tobytes(), times.astype("<u4").tobytes()), strict=True):
                        c.append(v)
                kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
                ids = [batch.column(c).slice(at, len(texts)) for c in ("row_id", "doc_id")]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in ROWS.split(", ")])

    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(arrow_map(numbered, run, ROWS), "alignment-rows")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n), each pair about once for every SUM_LINKS links of a task."""
    pairs, times, held = [], [], 0

    def summed() -> pa.RecordBatch:
        each, at = np.unique(np.concatenate(pairs), return_inverse=True)
        n = np.bincount(at, np.concatenate(times), len(each)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n)], names=["pair", "n"])

    for batch in batches:
        p, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), k) for c, k in (("pairs", "<u8"), ("times", "<u4")))
        pairs.append(p)
        times.append(t)
        held += len(p)
        if held > SUM_LINKS:
            yield summed()
            pairs, times, held = [], [], 0
    if held:
        yield summed()


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of all linked pairs: how many links hold it, and whether no other A id is linked with its B id more often."""
    counts = arrow_map(rows.select("pairs", "times"), _sums, PAIRS).groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))  # at most as many pairs as A has ids
    return materialize(counts.withColumn("best", F.col("n") == F.max("n").over(of_b)), "alignment-pairs")


def _often(pairs: DataFrame) -> int:
    """The least power of two such that at most HOT_PAIRS pairs have that count or more."""
    sizes = pairs.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("pairs")).collect()  # 64 rows at most
    total, least = 0, 64
    for r in sorted(sizes, key=lambda r: -r["bits"]):
        total += r["pairs"]
        if total > HOT_PAIRS:
            break
        least = r["bits"] - 1
    return 1 << least if least < 63 else (1 << 63) - 1


def alignment_counts(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = _rows(docs, _paths(a, b))
    pairs = pair_counts(rows)
    often = _often(pairs)
    hot = pairs.where(F.col("n") >= often).orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((hot["pair"].to_numpy().view(np.uint64), hot["n"].to_numpy(), hot["best"].to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the sums over frequent pairs, and one for each of its other pairs."""
        keys, counts, bests = shared.value
        keys, weights = np.append(keys, np.uint64(2**64 - 1)), np.append(counts, 0)
        names = [x.split()[0] for x in SCORES.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            raw_pairs, raw_times = batch.column("pairs").to_pylist(), batch.column("times").to_pylist()
            p, t = np.frombuffer(b"".join(raw_pairs), "<u8"), np.frombuffer(b"".join(raw_times), "<u4").astype(np.int64)
            of = np.repeat(np.arange(len(raw_pairs)), [len(x) // 8 for x in raw_pairs])
            at = np.searchsorted(keys, p)
            there = keys[at] == p
            best = np.append(bests, False)[at] & there
            sums = np.zeros(len(raw_pairs), np.int64)
            np.add.at(sums, of, np.where(there, t * weights[at], 0))
            n_best = np.bincount(of[best], t[best], len(raw_pairs)).astype(np.int64)
            nothing = pa.nulls(len(raw_pairs), pa.int64())
            kept = [batch.column(c) for c in names[:7]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best), pa.array(sums), nothing, nothing], names=names)
            rare = np.flatnonzero(~there)
            if len(rare):
                row_ids = batch.column("row_id").to_numpy()[of[rare]]
                none = [pa.nulls(len(rare), pa.string() if c == "groups_sha256" else pa.int64()) for c in names[1:9]]
                yield pa.RecordBatch.from_arrays([pa.array(row_ids), *none, pa.array(p[rare].view(np.int64)), pa.array(t[rare])], names=names)

    scored = materialize(arrow_map(rows, score, SCORES), "alignment-scores")
    rare = scored.where("pair IS NOT NULL").select("row_id", "pair", F.col("n").alias("times"))
    found = rare.join(pairs.where(F.col("n") < often), "pair").groupBy("row_id").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    out = scored.where("pair IS NULL").join(found, "row_id", "left")
    n_best, total = (F.col(x) + F.coalesce(y, F.lit(0)) for x, y in (("n_best", "more_best"), ("count_sum", "more")))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", n_best.alias("n_best"), total.alias("count_sum"), "groups_sha256")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"))
