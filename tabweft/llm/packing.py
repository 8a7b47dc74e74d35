"""Best-fit packing after Martello-Toth dominance reduction.

Lengths are integers of at most ``capacity``, so the instance is a histogram: how many pieces have each length.
The driver solves the histogram, whose size does not depend on the number of documents:

1. Reduction: for a length j, largest first, a small set {j} or {j, k} is fixed as often as it occurs if it
   *dominates* every other set that could share a sequence with j, that is if whatever else fits beside j would
   also fit in the place of k. The instance shrinks and the rule is applied until nothing changes.
2. Best fit, longest first, packs the remainder, in runs of equal sequences.

The plan maps (length, rank among the pieces of that length) to a sequence and a place. Ranks are counted without
gathering a length's pieces (:func:`running_offsets`), however many share it.

Null or empty texts have one id (the end id). Documents over ``capacity`` are cut; others never. Repeated rows are
packed each. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, materialize, running_offsets, table, text_bytes
from tabweft.llm.vocabulary import default_path, word_vocabulary

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long"


def _reach(counts: dict[int, int], sizes: list[int], j: int, room: int) -> int | None:
    """The largest k that beside j dominates all sets, 0 if j stays alone, None if nothing is proven."""

    def have(*items: int) -> bool:
        return all(items.count(x) + (x == j) <= counts[x] for x in set(items))

    fits = sizes[: bisect_left(sizes, room + 1)]
    fits = [x for x in fits if have(x)]
    if not fits:
        return 0
    k = fits[-1]
    if k == room:
        return k
    small = []  # the three shortest others, each as often as it is there
    for x in fits:
        small += [x] * min(3, counts[x] - (x == j))
        if len(small) >= 3:
            break
    if len(small) < 2 or small[0] + small[1] > room:
        return k  # one other piece at most: the longest replaces any
    if len(small) >= 3 and sum(small[:3]) <= room:
        return None
    best, lo, hi = 0, 0, len(fits) - 1  # the longest pair that fits
    while lo <= hi:
        both = fits[lo] + fits[hi]
        if both > room:
            hi -= 1
            continue
        if lo != hi or have(fits[lo], fits[lo]):
            best = max(best, both)
        lo += 1
    return k if best <= k else None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets; ``counts`` shrinks in place. Returns (lengths, times)."""
    fixed, changed = [], True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                sizes = sorted(counts)
                k = _reach(counts, sizes, j, capacity - j)
                if k is None:
                    break
                if k == 0:
                    taken, times = (j,), counts[j] if j * 2 > capacity else 1
                elif k == j:
                    taken, times = (j, k), counts[j] // 2
                else:
                    taken, times = (j, k), min(counts[j], counts[k])
                for x in taken:
                    counts[x] -= times
                for x in set(taken):
                    if not counts[x]:
                        del counts[x]
                fixed.append((taken, times))
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, in runs. Returns (lengths, times)."""
    rooms: list[int] = []  # sorted rooms that some open run has
    runs: dict[int, list[list]] = {}  # room -> [lengths, times]
    done: list[tuple[tuple[int, ...], int]] = []

    def add(lengths: tuple[int, ...], room: int, times: int) -> None:
        if not room:
            done.append((lengths, times))
        elif times:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append([lengths, times])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                full, rest = divmod(n, each)
                add((size,) * each, capacity - size * each, full)
                if rest:
                    add((size,) * rest, capacity - size * rest, 1)
                break
            room = rooms[at]
            lengths, times = run = runs[room][-1]
            take = min(n, times)
            run[1] -= take
            if not run[1]:
                runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            add((*lengths, size), room - size, take)
            n -= take
    return done + [(lengths, times) for room in rooms for lengths, times in runs[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, sequence of it, place) in order of rank."""
    left = dict(counts)
    patterns = reduce_by_dominance(left, capacity) + best_fit(left, capacity)
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, times in patterns:
        place = 0
        for x in lengths:
            rows.setdefault(x, []).append((used.get(x, 0), base, place))
            used[x] = used.get(x, 0) + times
            place += x
        base += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of the encoded documents: doc_id, uid, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_vocabulary(vocabulary)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                ids = words.encode(text) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for c, v in zip(cols, (doc_id, n, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        c.append(v)
            uid = np.frombuffer(os.urandom(8 * len(cols[0])), np.int64)
            arrays = [pa.array(cols[0], pa.int64()), pa.array(uid), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "uid", "piece", "start", "length", "ids_crc32"])

    return materialize(arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), pieces, PIECES), "pieces")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(docs, vocabulary or default_path("word_bpe_49k.json"), capacity, end_id)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    by_length = plan(counts, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for x in np.unique(lengths):
                at = np.flatnonzero(lengths == x)
                rows = by_length[int(x)]
                row = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1]
                sequence[at], offset[at] = row[:, 1] + ranks[at] - row[:, 0], row[:, 2]
            out = batch.drop_columns(["uid", "rank", "one"])
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    ranked = running_offsets(pieces.withColumn("one", F.lit(1)), "length", "uid", "one", "rank")
    names = ["doc_id", "uid", "piece", "start", "length", "ids_crc32", "one", "rank"]
    return arrow_map(ranked.select(names), place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
