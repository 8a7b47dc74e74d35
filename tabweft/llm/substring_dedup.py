"""Substring deduplication by sliding sentence spans.

A text is cut into sentences at line ends and after sentence marks; a sentence of ``GAP`` words or more is cut further
after the word of least hash of every ``GAP`` words (winnowing), so that text without marks has cuts that depend on its
words alone and no ``GAP`` words are without a cut. From every sentence, and back from every sentence, as many
consecutive ones as reach ``MIN_WORDS`` words, one or many, are a span. Spans are hashed (ASCII lower case, single
spaces) and the hashes are joined over all documents. The first occurrence of a span, by doc_id and place, stays; the
sentences that any other occurrence covers are removed, with the space before them up to the next cut.

A passage of 2 * GAP + MIN_WORDS - 1 = 35 words or more that repeats has a span in common with its first occurrence,
wherever its ends lie: a cut lies in its first GAP words, MIN_WORDS words follow, and the next cut comes in GAP words;
cuts that the words around the passage add lie before the first or after the last of these.

A span that very many documents share is shuffled once for each batch of documents: its other occurrences in the batch
are known not to be the first and go straight to their documents, as numbers of sentences. The rest meets by span, in order, in one shuffle.
Sentences of a document are gathered by document only.

Null texts stay null, empty ones empty. Rows that repeat a doc_id are documents
of their own (in the order of a hash of their texts); rows that repeat doc_id and text are one and are cut alike. Empty tables give empty results; clashing column names are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, materialize, table, text_bytes, unused

#: Words that a span needs.
MIN_WORDS = 12
#: Words of a sentence of which one is a cut.
GAP = 12

_END = re.compile(rb"(?<=[.!?])[ \t\n\r\x0b\x0c]+|[\t\r\x0b\x0c ]*\n[ \t\n\r\x0b\x0c]*")
#: A span's hash: 96 bits, so that no two of 1e12 spans are taken for equal.
_HASH = np.dtype([("span", "<i8"), ("check", "<i4"), ("rest", "<i4")])
_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
SPANS = "span long, check int, doc_id long, key long, at int, n int, gone array<int>"

_NAMES = [c.split()[0] for c in SPANS.split(", ")]


def picked(own: list[bytes]) -> list[int]:
    """Places of the words of least hash (the last of equals) of every GAP consecutive words."""
    hashes = [xxhash.xxh3_64_intdigest(w) for w in own]
    out, at = [], -1
    for i in range(GAP - 1, len(own)):
        if at <= i - GAP:
            at = min(range(i - GAP + 1, i + 1), key=lambda j: (hashes[j], -j))
        elif hashes[i] <= hashes[at]:
            at = i
        else:
            continue
        out.append(at)
    return out


def sentences(text: bytes) -> tuple[list[int], list[bytes]]:
    """Where each sentence starts (the first at 0), and its words joined by spaces in lower case."""
    starts, words = [], []
    begin = 0
    for end, following in [*(m.span() for m in _END.finditer(text)), (len(text), len(text))]:
        own = text[begin:end].lower().split()
        if len(own) >= GAP:
            places = [m.end() for m in _WORD.finditer(text, begin, end)]
            first = 0
            for i in picked(own):
                if i < len(own) - 1:
                    starts.append(begin)
                    words.append(b" ".join(own[first : i + 1]))
                    begin, first = places[i], i + 1
            own = own[first:]
        if own:
            starts.append(begin)
            words.append(b" ".join(own))
            begin = following
        elif not starts:
            continue
        else:
            begin = following
    if starts:
        starts[0] = 0
    return starts, words


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of span and check, first sentences, numbers of sentences) of the text's spans."""
    _, words = sentences(text)
    n = len(words)
    before = np.concatenate([[0], np.cumsum(np.fromiter((w.count(b" ") + 1 for w in words), np.int64, n))]).astype(np.int64)
    ends = np.searchsorted(before, before[:-1] + MIN_WORDS)
    starts = np.searchsorted(before, before[1:] - MIN_WORDS, "right") - 1
    ahead, back = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    both = np.unique(np.concatenate([ahead * (n + 1) + ends[ahead], starts[back] * (n + 1) + back + 1]))
    first, end = both // (n + 1), both % (n + 1)
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"\n".join(words[i:j])) for i, j in zip(first.tolist(), end.tolist(), strict=True)), _HASH)
    return hashes, first.astype(np.int32), (end - first).astype(np.int32)


def remove(text: bytes, gone: set[int]) -> bytes:
    """The text without the sentences numbered in ``gone``."""
    starts, _ = sentences(text)
    if not starts:
        return text
    ends = [*starts[1:], len(text)]
    return b"".join(text[a:b] for i, (a, b) in enumerate(zip(starts, ends, strict=True)) if i not in gone)


def covered(of: np.ndarray, at: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(documents, numbers of their sentences that some span (document, first, number) covers), of documents of so many sentences."""
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    change = np.zeros(first[-1] + 1, np.int64)
    np.add.at(change, first[of] + at, 1)
    np.add.at(change, first[of] + at + n, -1)
    places = np.flatnonzero(np.cumsum(change) > 0)
    document = np.searchsorted(first, places, "right") - 1
    some, starts = np.unique(document, return_index=True)
    numbers = (places - first[document]).astype(np.int32)
    return some, pa.ListArray.from_arrays(pa.array(np.append(starts, len(numbers)).astype(np.int32)), pa.array(numbers))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each span of every document that does not occur earlier in the batch, and for each document with
    others one row with the sentences that these cover."""
    for batch in batches:
        found = [windows(t) for t in text_bytes(batch)]
        if not sum(len(h) for h, _, _ in found):
            continue
        h, at, n = (np.concatenate(c) for c in zip(*found, strict=True))
        span, check = np.ascontiguousarray(h["span"]), np.ascontiguousarray(h["check"])
        of = np.repeat(np.arange(len(found)), [len(x) for x, _, _ in found])
        ids = batch.column("doc_id")
        keys = batch.column("key")
        by_order = np.lexsort((keys.to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        rank = _ranks(ids, keys, by_order)[of]
        order = np.lexsort((at, rank, check, span))
        group = np.concatenate([[True], (span[order][1:] != span[order][:-1]) | (check[order][1:] != check[order][:-1])])
        first = order[np.flatnonzero(group)][np.cumsum(group) - 1]
        late = np.empty(len(h), bool)
        late[order] = (rank[order] != rank[first]) | (at[order] != at[first])
        early = np.flatnonzero(~late)
        columns = [pa.array(span[early]), pa.array(check[early]), ids.take(pa.array(of[early])), keys.take(pa.array(of[early])), pa.array(at[early]), pa.array(n[early]), pa.nulls(len(early), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
        if late.any():
            sizes = np.fromiter((int((a + k).max()) if len(a) else 0 for _, a, k in found), np.int64, len(found))
            some, gone = covered(of[late], at[late], n[late], sizes)
            none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, ids.take(pa.array(some)), keys.take(pa.array(some)), none[1], none[1], gone], names=_NAMES)


def _ranks(ids: pa.Array, keys: pa.Array, by_order: np.ndarray) -> np.ndarray:
    """Places of the documents in ascending doc_id, null last, and key; equal ones have the same."""
    ordered = list(zip(*(c.take(pa.array(by_order)).to_pylist() for c in (ids, keys)), strict=True))
    out = np.zeros(len(ordered), np.int64)
    out[by_order] = np.cumsum([0, *(x != y for x, y in zip(ordered, ordered[1:], strict=False))])
    return out


def _key():
    """Tells the rows of one doc_id apart; rows of one text have the same and lose the same."""
    return F.xxhash64("text")


def repeated_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, key, gone): the numbers of the sentences that a non-first occurrence of a repeated span covers."""
    every = materialize(arrow_map(docs.select(F.col("doc_id").cast("long"), _key().alias("key"), "text"), _spans, SPANS), "span-rows")
    # equal places share a rank, so that neither is an occurrence after the other
    rank = F.rank().over(Window.partitionBy("span", "check").orderBy(F.col("doc_id").asc_nulls_last(), "key", "at"))
    met = every.where("gone IS NULL").drop("gone").withColumn("rank", rank).where("rank > 1")
    again = every.where("gone IS NOT NULL").select("doc_id", "key", "gone").unionByName(met.select("doc_id", "key", F.sequence(F.col("at"), F.col("at") + F.col("n") - 1).alias("gone")))
    return again.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))


def _apply(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, numbers = [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist(), strict=True):
                if gone and text:
                    text = remove(text.encode(), set(gone)).decode()
                out.append(text)
                numbers.append(len(gone or ()))
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, "text", pa.array(out, batch.schema.field("text").type))
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(numbers, pa.int64()))

    return run


def _cleaned(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with cleaned text and the number of sentences that went, and that column's name."""
    count, own_id, own_key = (unused(docs, c) for c in ("__gone", "__id", "__key"))
    gone = repeated_sentences(docs).select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("gone").alias(count))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own_id)) & (_key() == F.col(own_key)), "left").drop(own_id, own_key)
    schema = docs.select("*", F.lit(0).cast("long").alias(count)).schema
    return arrow_map(joined, _apply(count), schema), count


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated spans; columns as in ``docs``. A document may become empty, none is dropped."""
    out, count = _cleaned(docs)
    return out.drop(count)


def op7_sentence_span_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, text (what stays), removed_sentences, changed."""
    out, count = _cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col(count).alias("removed_sentences"), (F.col(count) > 0).alias("changed"))
