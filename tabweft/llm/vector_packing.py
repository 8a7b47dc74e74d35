"""Vector bin packing of training examples: tokens, segments and loss-bearing tokens of a sequence all have a limit.

Sequences are filled one after another. Of the examples that fit under all limits, the one with the largest dot
product of its demand and the room left goes in next, each dimension weighted by what the waiting examples still demand
of it; so a sequence short of one resource takes examples that use little of it. When nothing fits whole, one
example is cut to fill the rest. A sequence that still is not full (the limit of segments or of loss, or the end of
the partition) is cut back to a power of two of tokens, a length that needs no padding, and what is cut off waits on.

A task packs the partition that it reads, with a window of waiting examples of at most ``WINDOW`` tokens and one
batch, so nothing is shuffled, no task grows with the table, and a lost task is repeated with the same result. At
the end of a partition a few sequences of lengths 512, 256, ... take what is left.

Ids of an example before its ``prompt`` (a column, 0 if null or none) bear no loss. With ``cut=False`` examples stay
whole, one over a limit by itself fills a sequence alone, and sequences may be padded. Null or empty texts hold the end
id only. Repeated rows are packed each; doc_ids may be null; other columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, table, text_bytes
from tabweft.llm.parts import byte_vocabulary, runs_of
from tabweft.llm.vocabulary import default_path

CAPACITY, SEGMENTS, LOSS = 1024, 64, 1024
END_ID = 0
#: Tokens that wait for a sequence, besides those of the batch at hand.
WINDOW = 1 << 19
#: Sequence numbers of one partition.
_TASK_BITS = 36
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Window:
    """Examples that wait, and the sequences that they fill: (example, start, length) by place."""

    def __init__(self, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS, cut: bool = True):
        if min(capacity, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.capacity, self.loss, self.cut = capacity, loss, cut
        self.limits = np.array([capacity, segments, loss], float)
        self.added: list[tuple[int, int, int, int]] = []
        self.key, self.start, self.left, self.prompt = (np.zeros(0, np.int64) for _ in range(4))
        self.tokens = 0

    def add(self, key: int, tokens: int, prompt: int = 0) -> Iterator[list[tuple[int, int, int]]]:
        """Let an example wait. Stretches of it that fill a sequence by themselves come back at once."""
        start = 0
        while self.cut and tokens - start >= self.capacity and self.capacity - max(0, prompt - start) <= self.loss:
            yield [(key, start, self.capacity)]
            start += self.capacity
        if tokens > start:
            self.added.append((key, start, tokens - start, prompt))
            self.tokens += tokens - start

    def fill(self, until: int = 0) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences, until at most ``until`` tokens wait."""
        self._settle()
        used = 0
        while self.tokens > until:
            if used > len(self.key) // 2 + 64:
                self._settle()
                used = 0
            placed = self._sequence()
            used += len(placed)
            self.tokens -= sum(n for _, _, n in placed)
            yield [(int(self.key[i]), start, n) for i, start, n in placed]

    def _settle(self) -> None:
        """Take in what was added, drop what is used up."""
        kept = self.left > 0
        new = np.array(self.added, np.int64).reshape(-1, 4).T
        self.key, self.start, self.left, self.prompt = (np.concatenate([old[kept], n]) for old, n in zip((self.key, self.start, self.left, self.prompt), new, strict=True))
        self.added = []

    def _take(self, i: int, n: int) -> tuple[int, int, int]:
        piece = (i, int(self.start[i]), n)
        self.start[i] += n
        self.left[i] -= n
        return piece

    def _sequence(self) -> list[tuple[int, int, int]]:
        free = np.clip(self.prompt - self.start, 0, self.left)  # ids ahead that bear no loss
        waiting = self.left > 0
        demand = np.stack([self.left, waiting, self.left - free]).astype(float)
        weights = demand.sum(1) / self.limits**2
        room, placed = self.limits.copy(), []
        while room[1] >= 1:
            fits = waiting & (demand[0] <= room[0]) & (demand[2] <= room[2])
            i = int(np.where(fits, (weights * room) @ demand, -1.0).argmax())
            if not fits[i]:
                break
            room -= demand[:, i]
            waiting[i] = False
            placed.append(self._take(i, int(self.left[i])))
        if not self.cut:
            return placed or [self._take(i := int(waiting.argmax()), int(self.left[i]))]  # over a limit by itself
        if room[0] >= 1 and room[1] >= 1 and waiting.any():
            most = np.where(waiting, np.minimum(np.minimum(room[0], free + room[2]), self.left), 0).astype(np.int64)
            i = int((most * (1 << 32) + self.left).argmax())  # of equal ones the longest, whose rest is longest
            if most[i]:
                room[0] -= most[i]
                placed.append(self._take(i, int(most[i])))
        self._shorten(placed, int(self.capacity - room[0]))
        return placed

    def _shorten(self, placed: list[tuple[int, int, int]], total: int) -> None:
        """Give back tokens from the end until the length is the capacity or a power of two."""
        over = 0 if total == self.capacity else total - (1 << (total.bit_length() - 1))
        while over:
            i, start, n = placed.pop()
            back = min(n, over)
            self.start[i] -= back
            self.left[i] += back
            over -= back
            if back < n:
                placed.append((i, start, n - back))


def pack(docs: DataFrame, vocabulary: str | None = None, prompt: str | None = None, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS, end_id: int = END_ID, cut: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``docs``: doc_id, text, and ``prompt``, a column with the number of ids that bear no loss.
    """
    path, end = vocabulary or default_path("byte_bpe_50k.json"), np.array([end_id], "<u4").tobytes()
    kinds = [pa.int64()] * 8
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, window = byte_vocabulary(path), Window(capacity, segments, loss, cut)
        sequence = TaskContext.get().partitionId() << _TASK_BITS
        held: dict[int, list] = {}  # number -> [doc_id, ids, tokens that wait, prompt]
        number = 0

        def rows(sequences: Iterator[list[tuple[int, int, int]]], cols: list[list]) -> None:
            nonlocal sequence
            for placed in sequences:
                offset = 0
                for key, start, n in placed:
                    own = held[key]
                    doc_id, ids, _, first = own
                    bears = start + n - max(start, min(first, start + n))
                    for c, v in zip(cols, (doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, sequence, offset, bears), strict=True):
                        c.append(v)
                    offset += n
                    own[2] -= n
                    if not own[2]:
                        del held[key]
                sequence += 1

        for batch in batches:
            texts = text_bytes(batch)
            doc_ids = batch.column("doc_id").to_pylist()
            firsts = [max(0, p or 0) for p in batch.column("prompt").to_pylist()]
            for at, some in runs_of(texts):
                cols: list[list] = [[] for _ in names]
                for k, text in enumerate(some, at):
                    ids = words.packed(text) + end
                    held[number] = [doc_ids[k], ids, len(ids) // 4, firsts[k]]
                    rows(window.add(number, len(ids) // 4, firsts[k]), cols)
                    number += 1
                if window.tokens > 2 * WINDOW:
                    rows(window.fill(WINDOW), cols)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
        cols = [[] for _ in names]
        rows(window.fill(), cols)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    first = F.col(prompt).cast("long") if prompt else F.lit(0).cast("long")
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", first.alias("prompt")), run, PIECES)


def op12_vector_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("loss_tokens")
