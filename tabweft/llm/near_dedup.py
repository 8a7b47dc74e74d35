"""MinHash near-deduplication by a multi-index Hamming join.

A document's set holds its distinct 5-word shingles as 64-bit hashes (ASCII lower case; fewer words: the whole
sequence). Documents of equal sets form a *class* (128-bit key of the sorted set), so exact copies are one row from
here on; classes are numbered, so that their numbers are all different.

Signatures have ``SYMBOLS`` MinHash symbols of 32 bits, split into ``CHUNKS`` chunks of ``CHUNK`` symbols. By the
pigeonhole principle two signatures that differ in at most 2 * CHUNKS - 1 symbols agree in some chunk up to one
symbol, so enumerating the one allowed error of every chunk (leaving out each symbol in turn) gives keys of which
such a pair shares at least one: the join misses no pair under that signature distance. At a similarity of 0.75 a
pair lies over it with probability below 1e-5, as for that every chunk must have two errors.

Links are then found without all pairs of a bucket:

1. *Star rounds*: every member of a bucket is paired with the bucket's leader only. Pairs pass a byte signature
   filter (``WIDE`` symbols, five standard deviations below the threshold), and are confirmed on the full sets.
   Confirmed links are merged into components (large-star / small-star, no driver state). The first round takes
   the smallest class as leader, the second one chosen at random for each bucket.
2. *Completion*: buckets that still hold several components are compared across components. They are cut by set size
   first: sizes of linked sets differ by a third at most, so a member meets only its own band of sizes and the next.
   The largest component of such a group is compared with all others, not with itself, in tiles of bounded size;
   members outside it are copied to every tile, those inside only as often as the others fill tiles. Members of some
   pair that passes the filter are met again with their full sets, and every such pair whose components are still apart
   is confirmed there; pairs are never rows. Hence no link between two components is lost, whatever the leaders were.

Null or empty texts have empty sets, are linked with nothing and stay. A repeated doc_id gives a row each; a null
doc_id comes last and stays only if its whole component has none. Empty tables give empty results; other columns are ignored by :func:`components` and kept by :func:`drop_near_copies`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, materialize, mix64, shuffle_partitions, table, text_bytes, with_rows

SHINGLE = 5
#: Two sets are linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
CHUNK = 4
CHUNKS = 9
SYMBOLS = CHUNK * CHUNKS
#: Symbols of the byte signature, and how many must agree for a pair to be confirmed on the sets.
WIDE = 128
AGREE = 72
#: Members of each side of a tile, and bytes of their full sets, of which a side holds fewer members if its sets are long.
TILE, TILE_BYTES = 512, 32 << 20

_SEED = np.random.default_rng(75)
_WORD_ODD = (_SEED.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MUL = (_SEED.integers(1, 1 << 63, WIDE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _SEED.integers(1, 1 << 63, WIDE, dtype=np.uint64)
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SETS = "doc_id long, row_id long, n_shingles long, key_hi long, key_lo long, symbols binary, wide binary"


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles."""
    words = text.translate(_UPPER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, SHINGLE)
    with np.errstate(over="ignore"):
        out = hashes[: n - width + 1] * _WORD_ODD[0]
        for j in range(1, width):
            out = out + hashes[j : n - width + 1 + j] * _WORD_ODD[j]
    return np.unique(mix64(out + np.uint64(width)))


def signature(items: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of WIDE hash functions, as 32-bit symbols."""
    least = np.full(WIDE, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(items), 2048):
            least = np.minimum(least, ((items[None, k : k + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return (mix64(least) >> np.uint64(32)).astype(np.uint32)


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """(documents, keys): of every chunk, one key for each choice of the symbol that may differ."""
    columns = []
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            own = symbols[:, c * CHUNK : (c + 1) * CHUNK].astype(np.uint64)
            for n, kept in enumerate(combinations(range(CHUNK), CHUNK - 1)):
                h = np.full(len(own), c * CHUNK + n + 1, np.uint64)
                for i in kept:
                    h = mix64(h ^ (own[:, i] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1)))
                columns.append(h)
    return np.stack(columns, axis=1)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common) > 0


def _class_key(items: bytes) -> tuple[int, int]:
    hi, lo = divmod(xxhash.xxh3_128_intdigest(items), 1 << 64)
    return hi - (1 << 63), lo - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for text in text_bytes(batch):
            items = shingles(text)
            s = signature(items)
            for c, v in zip(cols, (len(items), *_class_key(items.tobytes()), s[:SYMBOLS].tobytes(), s.astype(np.uint8).tobytes()), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "row_id", "n_shingles", "key_hi", "key_lo", "symbols", "wide"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = keys_of(np.frombuffer(b"".join(batch.column("symbols").to_pylist()), np.uint32).reshape(-1, SYMBOLS))
            ids = np.repeat(batch.column("class_id").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "class_id"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t).tobytes() for t in text_bytes(batch)]
        keys = list(zip(*map(_class_key, sets), strict=True)) or [(), ()]  # of the text itself: a doc_id may stand for several
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()), pa.array(sets, pa.binary())], names=["key_hi", "key_lo", "items"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose byte signatures agree enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, WIDE) for c in ("wide_a", "wide_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(1) >= AGREE))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist(), strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sets], pa.bool_()))


TILE_KEY = ["key", "band", "tile_a", "tile_b"]
TILE_COLUMNS = [*TILE_KEY, "tile", "own", "class_id", "root", "n_shingles", "symbols", "wide"]
TILES = "key long, band int, tile_a int, tile_b int, tile int, own boolean, class_id long, root long, n_shingles long, symbols binary, wide binary"


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Scalar]]]:
    """The rows of every tile with more than one row, and their full sets if there are any; they come sorted by TILE_KEY.

    Sets are not put together: those of a tile may be more than one column holds.
    """
    at, parts = None, []

    def whole() -> Iterator[tuple[pa.RecordBatch, list[pa.Scalar]]]:
        if sum(p.num_rows for p in parts) > 1:
            facts = [c for c in parts[0].schema.names if c != "items"]
            yield pa.concat_batches([p.select(facts) for p in parts]), [x for p in parts if "items" in p.schema.names for x in p.column("items")]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in TILE_KEY]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for first, end in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            key = tuple(int(k[first]) for k in keys)
            if key != at:
                yield from whole()
                at, parts = key, []
            parts.append(batch.slice(first, end - first))
    yield from whole()


def _near_pairs(tile: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a tile to confirm: across components, of near sizes, of byte signatures that agree enough.

    A pair belongs to the first key that both share, so that its other buckets leave it out, to the lower band of the
    two, and to the tile of its two blocks.
    """
    key, _, tile_a, tile_b = (tile.column(c)[0].as_py() for c in TILE_KEY)
    ids, roots, blocks, sizes = (tile.column(c).to_numpy() for c in ("class_id", "root", "tile", "n_shingles"))
    own = tile.column("own").to_numpy(zero_copy_only=False)
    if (roots == roots[0]).all() or not own.any():
        return
    symbols, wide = (np.frombuffer(b"".join(tile.column(c).to_pylist()), t).reshape(len(ids), -1) for c, t in (("symbols", np.uint32), ("wide", np.uint8)))
    keys = keys_of(symbols).view(np.int64)
    for k in range(0, len(ids), 32):
        some = slice(k, k + 32)
        near = (ids[some, None] < ids) & (roots[some, None] != roots) & (own[some, None] | own)
        near &= (100 * sizes[some, None] >= PERCENT * sizes) & (100 * sizes >= PERCENT * sizes[some, None])
        if tile_a != tile_b:
            near &= blocks[some, None] != blocks
        x, y = np.nonzero(near)
        if len(x) > near.size // 4:
            agree = (wide[some, None, :] == wide[None, :, :]).sum(2, dtype=np.uint8)[x, y] >= AGREE
        else:
            agree = (wide[x + k] == wide[y]).sum(1, dtype=np.uint8) >= AGREE
        x, y = x[agree] + k, y[agree]
        if len(x):
            first = (keys[x] == keys[y]).argmax(1)
            mine = keys[x, first] == key
            yield x[mine], y[mine]


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile that are in some pair to confirm; never more rows than came."""
    for tile, _ in _by_tile(batches):
        held = np.zeros(tile.num_rows, bool)
        for x, y in _near_pairs(tile):
            held[x] = held[y] = True
        if held.any():
            yield tile.filter(pa.array(held))


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirm a tile's pairs on the full sets; a pair whose components the tile has joined already needs no test."""
    for tile, items in _by_tile(batches):
        ids, roots = tile.column("class_id").to_pylist(), tile.column("root").to_pylist()
        above: dict[int, int] = {}

        def find(x: int, above=above) -> int:
            while x in above:
                x = above[x]
            return x

        a, b = [], []
        for xs, ys in _near_pairs(tile):
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                u, v = find(roots[x]), find(roots[y])
                if u != v and linked(*(np.frombuffer(items[i].as_buffer(), np.uint64) for i in (x, y))):
                    above[max(u, v)] = min(u, v)
                    a.append(ids[x])
                    b.append(ids[y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def connect(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes in ``edges`` (a, b); the root is the smallest node of its component.

    Alternating large stars and small stars; both are an aggregation and a join, so a node with very many
    neighbours is pre-aggregated and its join is split.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "near-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialize(small.where("a != b").distinct(), "near-edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


class _Join:
    """State of one run: classes, buckets, and the components found so far."""

    def __init__(self, docs: DataFrame, row: str | None = None):
        row_id = F.col(row) if row else F.lit(0).cast("long")
        self.docs = docs.select(F.col("doc_id").cast("long"), row_id.alias("row_id"), "text")
        self.sets = materialize(arrow_map(self.docs, _sets, SETS), "near-sets")
        some = self.sets.where("n_shingles > 0")
        classes = some.groupBy("key_hi", "key_lo").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.max("symbols").alias("symbols"), F.max("wide").alias("wide"))
        self.classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()), "near-classes")
        keys = arrow_map(self.classes.select("class_id", "symbols"), _keys, "key long, class_id long")
        keys = materialize(keys, "near-keys")
        shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        self.buckets = materialize(keys.join(shared, "key").select("key", "class_id", "members"), "near-buckets")
        self.roots: DataFrame | None = None  # (class_id, root) of classes that are not their own root
        self.items: DataFrame | None = None

    def rooted(self) -> DataFrame:
        """Bucket members with their root, of buckets that hold more than one component."""
        if self.roots is None:
            return self.buckets.withColumn("root", F.col("class_id"))
        found = self.buckets.join(self.roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
        mixed = found.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        return materialize(found.join(mixed, "key"), "near-mixed")

    def star(self, by) -> None:
        """Pair every member with its bucket's leader, the first by ``by``; merge what is confirmed."""
        members = self.rooted()
        lead = members.groupBy("key").agg(F.min_by(F.struct("class_id", "root"), by).alias("lead"))
        pairs = members.join(lead, "key").where((F.col("class_id") != F.col("lead.class_id")) & (F.col("root") != F.col("lead.root")))
        pairs = pairs.select(F.least("class_id", "lead.class_id").alias("a"), F.greatest("class_id", "lead.class_id").alias("b")).distinct()
        wide = self.classes.select("class_id", "wide")
        pairs = pairs.join(wide.select(F.col("class_id").alias("a"), F.col("wide").alias("wide_a")), "a").join(wide.select(F.col("class_id").alias("b"), F.col("wide").alias("wide_b")), "b")
        self.merge(materialize(arrow_map(pairs, _similar, "a long, b long"), "near-pairs"))

    def complete(self) -> None:
        """Compare the buckets that still hold several components, across components."""
        rows = self.rooted().drop("members").join(self.classes.select("class_id", "n_shingles", "symbols", "wide"), "class_id")
        size_band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / PERCENT)).cast("int")
        rows = rows.withColumn("size_band", size_band).withColumn("band", F.explode(F.array(F.col("size_band") - 1, F.col("size_band")))).withColumn("own", F.col("band") == F.col("size_band"))
        group = ["key", "band"]
        each = rows.groupBy(*group, "root").agg(F.count("*").alias("n"), F.max("own").alias("has"))
        groups = each.groupBy(group).agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n"), F.count("*").alias("roots"), F.max("has").alias("has"))
        # a set of the band or the next holds less than this many shingles of 8 bytes
        longest = F.pow(F.lit(100 / PERCENT), F.col("band") + 2) * 8
        block = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_BYTES) / longest)))
        groups = groups.where("roots > 1 AND has").select(*group, "major", F.ceil(F.col("n_major") / block).cast("int").alias("majors"), F.ceil((F.col("n") - F.col("n_major")) / block).cast("int").alias("others"))
        rows = rows.join(groups, group)
        large, at = F.col("root") == F.col("major"), F.xxhash64("class_id")
        rows = rows.withColumn("tile", F.when(large, F.pmod(at, F.col("majors"))).otherwise(F.col("majors") + F.pmod(at, F.col("others"))).cast("int"))
        # blocks of the largest component do not meet each other
        other = F.explode(F.sequence(F.when(large, F.col("majors")).otherwise(0), F.col("majors") + F.col("others") - 1))
        rows = rows.withColumn("other", other).withColumn("tile_a", F.least("tile", "other")).withColumn("tile_b", F.greatest("tile", "other"))
        involved = materialize(arrow_map(self._dealt(rows.select(TILE_COLUMNS)), _involved, TILES), "near-involved")
        with_items = involved.join(self._items_of(involved.select("class_id")), "class_id")
        self.join_components(materialize(arrow_map(self._dealt(with_items.select(*TILE_COLUMNS, "items")), _tile_links, "a long, b long"), "near-links"))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Tiles by hash, the rows of a tile together."""
        return rows.repartition(shuffle_partitions(self.docs.sparkSession), *TILE_KEY).sortWithinPartitions(*TILE_KEY)

    def merge(self, pairs: DataFrame) -> None:
        """Confirm candidate pairs on the full sets and join their components."""
        items = self._items_of(pairs.select(F.explode(F.array("a", "b")).alias("class_id")))
        a = items.select(F.col("class_id").alias("a"), F.col("items").alias("items_a"))
        b = items.select(F.col("class_id").alias("b"), F.col("items").alias("items_b"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "items_a", "items_b")
        self.join_components(materialize(arrow_map(both, _confirm, "a long, b long"), "near-links"))

    def join_components(self, links: DataFrame) -> None:
        if self.roots is None:
            self.roots = connect(links).withColumnRenamed("node", "class_id")
            return
        for c in ("a", "b"):
            links = links.join(self.roots.withColumnRenamed("class_id", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        moved = connect(links)
        old = self.roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("class_id", F.coalesce("new", "root").alias("root"))
        # a root that moves, or a class that was alone until now, gets a row of its own
        alone = moved.select(F.col("node").alias("class_id"), "root").join(self.roots.select("class_id"), "class_id", "left_anti")
        self.roots = materialize(old.unionByName(alone), "near-roots")

    def _items_of(self, classes: DataFrame) -> DataFrame:
        """(class_id, items) of at least these classes; texts are shingled again only for classes without items yet."""
        wanted = classes.distinct()
        if self.items is not None:
            wanted = wanted.join(self.items.select("class_id"), "class_id", "left_anti")
        classes = self.classes.join(wanted, "class_id").select("class_id", "key_hi", "key_lo", F.col("doc_id").alias("holder"))
        texts = self.docs.join(classes.select("holder").distinct(), F.col("doc_id").eqNullSafe(F.col("holder")), "left_semi")
        found = arrow_map(texts.select("text"), _texts, "key_hi long, key_lo long, items binary")
        new = materialize(found.join(classes, ["key_hi", "key_lo"]).select("class_id", "items").dropDuplicates(["class_id"]), "near-items")
        self.items = new if self.items is None else self.items.unionByName(new).dropDuplicates(["class_id"])
        return self.items


def _rows(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, row_id (the value of column ``row``), n_shingles, root (null without shingles), component_id."""
    run = _Join(docs, row)
    run.star(F.col("class_id"))
    run.star(F.xxhash64("key", "class_id"))
    run.complete()
    roots = run.classes.select("class_id", "key_hi", "key_lo", "doc_id").join(run.roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    roots = materialize(roots, "near-rooted")
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = roots.join(least, "root").select("key_hi", "key_lo", "root", "component_id")
    out = run.sets.select("doc_id", "row_id", "n_shingles", "key_hi", "key_lo").join(of_class, ["key_hi", "key_lo"], "left")
    return out.select("doc_id", "row_id", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    return _rows(docs).drop("row_id", "root").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents of which one of each component stays, that with the smallest doc_id (null last); columns as in ``docs``.

    Verdicts go by row: of rows with one doc_id each is judged by its own text, and one of a component stays.
    """
    keyed, row = with_rows(docs, "near-rows")
    rows = materialize(_rows(keyed, row).where("root IS NOT NULL"), "near-verdicts")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_id")
    lead = rows.groupBy("root").agg(F.min(order).alias("lead"))
    gone = rows.join(lead, "root").where(F.col("row_id") != F.col("lead.row_id")).select(F.col("row_id").alias(row))
    return keyed.join(gone, row, "left_anti").select(docs.columns)


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    return r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
    """
