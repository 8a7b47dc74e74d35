"""Groups of spelling variants by rolling-hash deletions.

Two words are near if one inserted, deleted or replaced code point makes them equal, which is to say: one is what a
deletion leaves of the other, or deletions at one place leave the same of both. So every word yields a key for itself and one for
each deletion. With polynomial hashes of all prefixes and suffixes a deletion's hash is one multiplication and one
addition, over all words of a length at once; deletions within a run of equal letters leave the same and share a key, with
the range of their places. Keys are dealt by their top bits (radix) and sorted; only keys that occur twice are looked at,
and there the strings decide, so a collision of hashes changes nothing.

A key's words need no pairs: at each place of what is left stand at most as many different words as there are letters, and each
takes the best of the others; the word that is itself what is left meets its extensions one by one. Words of over
``LONG`` letters do not travel with each of their keys: their candidate pairs fetch the strings in a join.

A word's form is its near word of largest count (ties: smallest), if that is at least twice its own; the root follows
the forms by pointer doubling. Counts double along the way, so there are no circles.

Words come from whole texts; null and empty texts have none. Repeated rows count each. A null doc_id reads as
an empty string in the rule that damages words. Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, materialize, mix64, shuffle_partitions, table

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run of letters is damaged if this divides its hash (None: never).
DAMAGE = 97
#: Letters of the longest remainder whose words travel with its key.
LONG = 128
#: Different words that a task counts before it hands its counts on.
COUNTED = 200_000
#: Keys for one partition at most, on average.
PART_KEYS = 4_000_000
RADIX_BITS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Latin-1 letters with A to Z in lower case; all else becomes a space, as does what Latin-1 does not have.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
KEYS = "key long, id long, word string, n long, length int, lo int, hi int"
EVIDENCE = "id long, n_near long, best_n long, best_word string, best_id long"
PAIRS = "a long, b long"
_KINDS = {"key": pa.int64(), "id": pa.int64(), "word": pa.string(), "n": pa.int64(), "length": pa.int32(), "lo": pa.int32(), "hi": pa.int32()}


def runs(text: str | None) -> list[bytes]:
    """The runs of letters in Latin-1, one byte a letter, A to Z in lower case."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def damaged(doc_id: int | None, run: bytes, every: int | None = DAMAGE, crc: int | None = None) -> bytes:
    """The run, or the run less one letter where the hash of document and run says so. ``crc``: that of ``doc_id:``, if known."""
    if every is None:
        return run
    if crc is None:
        crc = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, every: int | None = DAMAGE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(id, word, n) of all words that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                crc = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
                for run, k in Counter(runs(text.as_py())).items():
                    if len(run) >= least_length:
                        word = damaged(doc_id, run, every, crc)
                        if len(word) >= least_length:
                            total[word] = total.get(word, 0) + k
                if len(total) > COUNTED:
                    yield flush()
        yield flush()

    counts = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count, "word string, n long")
    words = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    return materialize(words.withColumn("id", F.monotonically_increasing_id()).select("id", "word", "n"), "variant-words")


def deletion_keys(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words of one length, a row of letters each: of the whole words, and (words x places) of what deletions leave."""
    n, length = letters.shape
    letters = letters.astype(np.uint64) + np.uint64(1)
    power = np.ones(length + 1, np.uint64)
    np.multiply.accumulate(np.full(length, _BASE), out=power[1:])
    prefix, suffix = np.zeros((length + 1, n), np.uint64), np.zeros((length + 1, n), np.uint64)
    for i in range(length):
        prefix[i + 1] = prefix[i] * _BASE + letters[:, i]
        suffix[length - 1 - i] = letters[:, length - 1 - i] * power[i] + suffix[length - i]
    left = prefix[:-1] * power[length - 1 :: -1, None][:length] + suffix[1:]
    # words and remainders of one length share keys, others do not
    sizes = np.array([length, length - 1], np.uint64) * _BASE
    return mix64(prefix[-1] + sizes[0]), mix64(left.T + sizes[1])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for length, at in by_length.items():
            each = max(1, (1 << 19) // length)
            for k in range(0, len(at), each):
                yield _keys_of(batch, words, np.array(at[k : k + each]), length)


def _keys_of(batch: pa.RecordBatch, words: list[bytes], at: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows of words of one length: (lo, hi) are the places of the deletions, -1 for the word itself; ``length`` is that of what is left."""
    letters = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), length)
    whole, left = deletion_keys(letters)
    first = np.ones((len(at), length), bool)  # of a run of equal letters
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    row, lo = np.nonzero(first)
    after = np.append(lo[1:], 0)
    hi = np.where(np.append(row[1:] == row[:-1], False), after - 1, length - 1)
    key = np.concatenate([whole, left[row, lo]]).view(np.int64)
    row = np.concatenate([np.arange(len(at)), row])
    size = np.concatenate([np.full(len(at), length), np.full(len(lo), length - 1)])
    lo, hi = (np.concatenate([np.full(len(at), -1), x]) for x in (lo, hi))
    source = pa.array(at[row])
    word = batch.column("word").take(source)
    if length > LONG:
        word = pa.array([w if n <= LONG else None for w, n in zip(word, size.tolist(), strict=True)], pa.string()) if length == LONG + 1 else pa.nulls(len(row), pa.string())
    columns = [pa.array(key), batch.column("id").take(source), word, batch.column("n").take(source), *(pa.array(x.astype(np.int32)) for x in (size, lo, hi))]
    return pa.RecordBatch.from_arrays(columns, names=list(_KINDS))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[tuple]]]:
    """Of each batch the rows (id, word, n, length, lo, hi) of every key that occurs more than once; rows come sorted by key."""
    held: pa.Table | None = None

    def groups(rows: pa.Table) -> list[list[tuple]]:
        key = rows.column("key").to_numpy()
        new = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        many = np.repeat(sizes > 1, sizes)
        if not many.any():
            return []
        some = rows.filter(pa.array(many))
        values = list(zip(*(some.column(c).to_pylist() for c in ("id", "word", "n", "length", "lo", "hi")), strict=True))
        ends = np.cumsum(sizes[sizes > 1]).tolist()
        return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        key = rows.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        held = rows.slice(last)
        if last:
            yield groups(rows.slice(0, last))
    if held is not None:
        yield groups(held)


def _by_remainder(rows: list[tuple]) -> Iterator[tuple[list[tuple], list[list[tuple]]]]:
    """(words that are the remainder, extensions at each place) of every remainder among rows of one key.

    Where words are there, remainders are strings; where they are not, only their lengths tell remainders apart.
    """
    by: dict[object, list[tuple]] = defaultdict(list)
    for r in rows:
        word, length, lo = r[1], r[3], r[4]
        by[length if word is None else word if lo < 0 else word[:lo] + word[lo + 1 :]].append(r)
    for own in by.values():
        if len(own) > 1:
            places: dict[int, list[tuple]] = defaultdict(list)
            for r in own:
                if r[4] >= 0:
                    for p in range(r[4], r[5] + 1):
                        places[p].append(r)
            yield [r for r in own if r[4] < 0], [x for x in places.values() if len(x) > 1] if len(own) > 1 else []


def _better(a: tuple | None, b: tuple) -> tuple:
    """Of two (n, word, id) that of larger count, then of smaller word."""
    return b if a is None or (-b[0], b[1]) < (-a[0], a[1]) else a


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words and the best of them, for every word and batch of keys; the strings decide."""
    for groups in _shared(batches):
        found: dict[int, list] = {}

        def note(word_id: int, near: int, best: tuple, found=found) -> None:
            own = found.setdefault(word_id, [0, None])
            own[0] += near
            own[1] = _better(own[1], best)

        for rows in groups:
            if rows[0][1] is None:
                continue
            for itself, places in _by_remainder(rows):
                for whole in itself:
                    longer = {r[0]: r for r in rows if r[1] is not None and r[4] >= 0 and r[1][: r[4]] + r[1][r[4] + 1 :] == whole[1]}
                    for r in longer.values():
                        note(whole[0], 1, (r[2], r[1], r[0]))
                        note(r[0], 1, (whole[2], whole[1], whole[0]))
                for same in places:
                    first, second = sorted(same, key=lambda r: (-r[2], r[1]))[:2]
                    for r in same:
                        other = second if r is first else first
                        note(r[0], len(same) - 1, (other[2], other[1], other[0]))
        ids, values = list(found), list(found.values())
        columns = [pa.array(ids, pa.int64()), pa.array([v[0] for v in values], pa.int64()), *(pa.array([v[1][k] for v in values], t) for k, t in ((0, pa.int64()), (1, pa.string()), (2, pa.int64())))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_near", "best_n", "best_word", "best_id"])


def _long_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of words that did not travel with their keys, the smaller id first."""
    for groups in _shared(batches):
        pairs = set()
        for rows in groups:
            long = [r for r in rows if r[1] is None]
            for itself, places in _by_remainder(long) if len(long) > 1 else ():
                pairs |= {(w[0], r[0]) for w in itself for r in long if r[4] >= 0 and r[3] == w[3]}
                pairs |= {(x[0], y[0]) for same in places for i, x in enumerate(same) for y in same[:i]}
        pairs = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes the words equal."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    lo, hi = 0, len(a)  # the common prefix, by halves
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return a[lo + (len(a) == len(b)) :] == b[lo + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [near(x, y) for x, y in zip(batch.column("word").to_pylist(), batch.column("best_word").to_pylist(), strict=True)]
        yield batch.select(["id", "n_near", "best_n", "best_word", "best_id"]).filter(pa.array(keep, pa.bool_()))


def evidence(words: DataFrame) -> DataFrame:
    """One row per word (id, word, n) with near words: id, n_near, and best (minus n, word, id), the near word of largest count."""
    spark = words.sparkSession
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-total // PART_KEYS))
    keys = arrow_map(words, _keys, KEYS)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")

    found = arrow_map(dealt(keys.where("word IS NOT NULL")), _evidence, EVIDENCE)
    long = words.where(F.length("word") > LONG)
    pairs = arrow_map(dealt(arrow_map(long, _keys, KEYS).where("word IS NULL")), _long_pairs, PAIRS).distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = long.select(F.col("id").alias("a"), "word").hint("merge"), long.select(F.col("id").alias("b"), F.col("word").alias("best_word"), F.col("n").alias("best_n")).hint("merge")
    both = both.join(ends[0], "a").join(ends[1], "b").select(F.col("a").alias("id"), F.lit(1).cast("long").alias("n_near"), "best_n", "best_word", F.col("b").alias("best_id"), "word")
    found = found.unionByName(arrow_map(both, _verified, EVIDENCE))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word"), F.col("best_id").alias("id")))
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of every row of ``forms`` (id, form): the last along the forms. Pointers double in length each round."""
    now = materialize(forms.select("id", F.col("form").alias("root")), "variant-roots")
    while True:
        after = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(after, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if not now.where("moved").limit(1).count():
            return now.select("id", "root")
        now = now.select("id", "root")


def variants(docs: DataFrame, every: int | None = DAMAGE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = count_words(docs, every)
    known = words.join(evidence(words), "id", "left")
    holds = F.col("best.less") <= -2 * F.col("n")
    known = materialize(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(holds, x).alias(c) for c, x in (("form", F.col("best.word")), ("form_n", -F.col("best.less")), ("form_id", F.col("best.id"))))), "variant-known")
    last = roots(known.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    named = last.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return known.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
