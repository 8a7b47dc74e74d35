"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Leaf i of a word's tree holds (rank, i) of the pair that starts at symbol i, or infinity; every node holds the
minimum of its children, so the root is the leftmost pair of lowest rank. A merge changes three leaves, whose paths
to the root are recomputed in logarithmic time; encoding ends when the root is infinite. Trees of equal width are
kept as rows of one array and advance together, a merge for each word and round. Words are split off by the
pattern that the tokenizer file names, special tokens first; each distinct word is encoded once per worker while it is
remembered, and with its ids are kept their digits and the bytes that they decode to.

Null texts count as empty (no ids). Very long words are encoded whole, by one tree of about 50 bytes a byte. Repeated
rows and empty tables need no care; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, table
from tabweft.llm.vocabulary import MEMO, MEMO_BYTES, byte_symbols, default_path

#: Fixed value: how byte-level vocabularies split a text if their file names no pattern of its own.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of one array of trees.
TREES = 8192
#: Fewer words than LONE of at least LONE_WIDTH bytes do not fill the rounds of an array of trees: each goes alone, merge after merge.
LONE, LONE_WIDTH = 32, 256
#: Text that is split before its new words are encoded.
SPLIT_BYTES = 1 << 20
_NONE = np.int64(1) << np.int64(62)
_IDS, _DIGITS, _BYTES = itemgetter(0), itemgetter(1), itemgetter(2)


def split_pattern(spec: dict) -> str:
    """The pattern by which a tokenizer file splits words; ValueError if it does more than that."""
    if spec.get("normalizer"):
        raise ValueError("a byte-level vocabulary with a normalizer is not supported")
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    last = steps[-1]
    if last.get("type") != "ByteLevel" or last.get("add_prefix_space") or spec["model"].get("type") != "BPE" or spec["model"].get("ignore_merges"):
        raise ValueError("only byte-level BPE without a prefix space is supported")
    if len(steps) == 1 and last.get("use_regex", True):
        return SPLIT
    first = steps[0]
    isolated = first.get("type") == "Split" and first.get("behavior") == "Isolated" or first.get("behavior") == "Removed" and first.get("invert")
    if len(steps) != 2 or not isolated or last.get("use_regex", True) or "Regex" not in first["pattern"]:
        raise ValueError("the file's way of splitting words is not supported")
    return first["pattern"]["Regex"]


class SegmentTreeBpe:
    """Encoder and decoder of a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], _NONE), np.append(order, 0).astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.split = regex.compile(split_pattern(spec))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.digits = {i: b"%d" % i for i in self.token_bytes}
        self.known: dict[str, tuple[tuple[int, ...], bytes, bytes]] = {}  # word -> ids, their digits, what they decode to
        self.long: list[str] = []
        self.rank_of: dict[int, int] | None = None

    def _rank(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (left, right) at positions ``at``; right < 0: no pair."""
        key = (left.astype(np.int64) << 32) | np.maximum(right, 0)
        found = np.searchsorted(self.keys, key)
        return np.where((right >= 0) & (self.keys[found] == key), (self.ranks[found] << 32) | at, _NONE)

    def _encode_rows(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Encode words of at most ``width`` bytes, a power of two, each with a tree of that width."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        column = np.arange(width, dtype=np.int32)
        ids = np.full((n, width + 1), -1, np.int32)  # the last column stands for "no symbol"
        ids[:, :width][column < lengths[:, None]] = self.byte_ids[flat]
        after = np.tile(np.append(column + 1, np.int32(width)), (n, 1))
        before = np.tile(np.concatenate([[width], column[:-1], [width]]).astype(np.int32), (n, 1))
        tree = np.full((n, 2 * width), _NONE)
        for k in range(0, width, 1 << 16):  # the temporary arrays of a long word stay small
            some = slice(k, min(k + (1 << 16), width))
            leaves = self._rank(ids[:, some], ids[:, some.start + 1 : some.stop + 1], column[some])
            leaves[ids[:, some] < 0] = _NONE
            tree[:, width + some.start : width + some.stop] = leaves
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            roots = tree[rows * (2 * width) + 1]
            rows = rows[roots < _NONE]
            if not len(rows):
                break
            roots = roots[roots < _NONE]
            base, root = rows * (width + 1), rows * (2 * width)
            at, new = roots & 0xFFFFFFFF, self.merged[roots >> 32]
            gone = after[base + at]
            following, previous = after[base + gone], before[base + at]
            ids[base + at] = new
            ids[base + gone] = -1
            after[base + at] = following
            before[base + following] = at  # of "no symbol" too, where nothing reads it
            tree[root + width + gone] = _NONE
            tree[root + width + at] = self._rank(new, ids[base + following], at)
            had = previous < width
            tree[(root + width + previous)[had]] = self._rank(ids[base + previous], new, previous)[had]
            for leaf, r in ((gone, root), (at, root), (previous[had], root[had])):
                node = leaf + width
                while node.size and node[0] > 1:
                    node = node >> 1
                    tree[r + node] = np.minimum(tree[r + 2 * node], tree[r + 2 * node + 1])
        ids = ids.reshape(n, width + 1)[:, :width]
        kept = ids >= 0
        ends = np.cumsum(kept.sum(1)).tolist()
        out = ids[kept].tolist()
        return [tuple(out[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _encode_lone(self, word: bytes) -> tuple[int, ...]:
        """Encode one long word: the same tree, with one point update after another, each up to where no minimum changes."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.keys[:-1].tolist(), self.ranks[:-1].tolist(), strict=True))
        n, none, rank_of, merged = len(word), int(_NONE), self.rank_of, self.merged
        width = 1 << max(1, (n - 1).bit_length())
        first = np.append(self.byte_ids[np.frombuffer(word, np.uint8)], -1)
        tree = np.full(2 * width, _NONE)
        for k in range(0, n, 1 << 16):  # the temporary arrays stay small
            end = min(k + (1 << 16), n)
            tree[width + k : width + end] = self._rank(first[k:end], first[k + 1 : end + 1], np.arange(k, end))
        level = width
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        tree, ids = array("q", tree.tobytes()), array("i", first.astype(np.int32).tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        while tree[1] < none:
            root = tree[1]
            at, new = root & 0xFFFFFFFF, int(merged[root >> 32])
            gone = after[at]
            following, previous = after[gone], before[at]
            ids[at], ids[gone], after[at] = new, -1, following
            put(gone, none)
            if following < n:
                before[following] = at
            rank = rank_of.get(new << 32 | ids[following]) if following < n else None
            put(at, none if rank is None else rank << 32 | at)
            if previous >= 0:
                rank = rank_of.get(ids[previous] << 32 | new)
                put(previous, none if rank is None else rank << 32 | previous)
        out = np.frombuffer(ids, np.int32)[:n]
        return tuple(out[out >= 0].tolist())

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words that the pattern has split off, each on its own."""
        raw = [w.encode() for w in words]
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            by_width.setdefault(1 << (len(w) - 1).bit_length() if w else 1, []).append(i)
        out: list[tuple[int, ...]] = [()] * len(raw)
        for width, at in by_width.items():
            if width >= LONE_WIDTH and len(at) < LONE:
                for i in at:
                    out[i] = self._encode_lone(raw[i])
                continue
            each = max(LONE, TREES * 8 // width)
            for k in range(0, len(at), each):
                for i, ids in zip(at[k : k + each], self._encode_rows([raw[i] for i in at[k : k + each]], width), strict=True):
                    out[i] = ids
        return out

    def words_of(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        return list(chain.from_iterable([p] if p in self.special else self.split.findall(p) for p in self.special_split.split(text)))

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not remembered; long ones are forgotten by the next call."""
        for w in self.long:
            self.known.pop(w, None)
        if len(self.known) > MEMO:
            self.known.clear()
        new = list(words.difference(self.known, self.special))
        self.long = [w for w in new if len(w) > MEMO_BYTES]
        for w, ids in chain(zip(new, self.encode_words(new), strict=True), ((s, (i,)) for s, i in self.special.items())):
            self.known[w] = ids, b",".join(map(self.digits.__getitem__, ids)), b"".join(map(self.token_bytes.__getitem__, ids))

    def _pieces(self, texts: list[str]) -> Iterator[list[tuple[tuple[int, ...], bytes, bytes]]]:
        words = [self.words_of(t) for t in texts]
        self.learn(set(chain.from_iterable(words)))
        for own in words:
            yield list(map(self.known.__getitem__, own))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[int, ...]]:
        for pieces in self._pieces(texts):
            yield tuple(chain.from_iterable(map(_IDS, pieces)))

    def encode_and_decode(self, texts: list[str]) -> Iterator[tuple[int, bytes, str]]:
        """(number of ids, their digits joined by commas, the text that they decode to) of each text."""
        for pieces in self._pieces(texts):
            raw = b"".join(map(_BYTES, pieces))
            yield sum(map(len, map(_IDS, pieces))), b",".join(map(_DIGITS, pieces)), raw.decode("utf-8", "replace")

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, SegmentTreeBpe] = {}


def load(path: str) -> SegmentTreeBpe:
    if path not in _loaded:
        _loaded[path] = SegmentTreeBpe(path)
    return _loaded[path]


def _some(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in runs of about SPLIT_BYTES."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size > SPLIT_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids array<int>."""
    path = vocabulary or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [list(x) for texts in _some(batch.column("text").to_pylist()) for x in bpe.encode_all(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``encoded`` (doc_id, ids): doc_id, text. Null ids give an empty text."""
    path = vocabulary or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow_map(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, of a whole encoding and its decoding."""
    path = vocabulary or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for texts in _some(batch.column("text").to_pylist()):
                for n, digits, decoded in bpe.encode_and_decode(texts):
                    counts.append(n)
                    ids_sha.append(hashlib.sha256(digits).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_segment_tree_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
