"""Sharding by Karmarkar-Karp differencing: near-equal bytes with indivisible groups of equal texts.

A *partial partition* is a tuple of ``n_shards`` byte sums. Differencing takes the two with the largest spread
(largest minus smallest sum) and adds them oppositely ordered, until one is left. It is sequential, so its input
must not grow with the corpus: groups of more than 1/``BUNDLES`` of all bytes enter alone (there are fewer than
``BUNDLES``), all others are first bundled by a hash of their text into ``BUNDLES`` bundles. The driver thus
differences the sums of at most 2 * ``BUNDLES`` items at any scale, and sends back as many shard numbers, a
broadcast of fixed size. Adding two partial partitions oppositely ordered never gives a spread above the larger of
theirs, so the shards' spread is at most the largest item: the largest group, or the largest bundle, which holds
about 1/``BUNDLES`` of all bytes. A group is never divided; one larger than its share alone sets the spread.

Groups are equal texts (null equals empty), found by a 128-bit hash with sums taken before the shuffle, so a group
that holds a third of all rows is one row there. Slots are counted over hash chunks of the rows, not over shards
or groups. Repeated rows each get a slot. Empty tables give empty results; other columns are ignored by
:func:`shard_documents` and kept by :func:`write_shards`.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweft.llm.common import arrow_map, materialize, running_offsets, table, text_bytes, with_rows

N_SHARDS = 24
#: Bytes of every document besides its text.
ROW_BYTES = 8
#: Bundles of small groups, and the bound on the number of large ones.
BUNDLES = 32_768
ROWS = "doc_id long, uid long, size long, text_crc32 long, group_key long, group_check long"


def difference(partials: list[tuple[list[int], list]]) -> tuple[list[int], list]:
    """Combine partial partitions (sums, members), both by shard, into one.

    ``members[s]`` is a tree: None, a leaf, or a pair of trees.
    """
    heap = []
    for n, (sums, members) in enumerate(partials):
        order = sorted(range(len(sums)), key=sums.__getitem__)
        ordered = [sums[i] for i in order]
        heap.append((ordered[0] - ordered[-1], n, ordered, [members[i] for i in order]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        both = sorted(((x + y, i) for i, (x, y) in enumerate(zip(a, reversed(b), strict=True))))
        pairs = [m if o is None else o if m is None else (m, o) for m, o in zip(left, reversed(right), strict=True)]
        sums = [x for x, _ in both]
        n += 1
        heapq.heappush(heap, (sums[0] - sums[-1], n, sums, [pairs[i] for _, i in both]))
    return heap[0][2], heap[0][3]


def leaves(tree) -> Iterator:
    stack = [tree] if tree is not None else []
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        else:
            yield x


def difference_sizes(sizes: list[int], n_shards: int) -> list[int]:
    """The shard of each size: every size starts as a partial partition of its own."""
    partials = [([0] * (n_shards - 1) + [size], [None] * (n_shards - 1) + [at]) for at, size in enumerate(sizes)]
    out = [0] * len(sizes)
    for shard, tree in enumerate(difference(partials)[1] if partials else []):
        for at in leaves(tree):
            out[at] = shard
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch)
        keys = np.fromiter((h for t in texts for h in divmod(xxhash.xxh3_128_intdigest(t), 1 << 64)), np.uint64, 2 * len(texts)).view(np.int64)
        arrays = [batch.column("doc_id"), batch.column("uid"), pa.array([len(t) + ROW_BYTES for t in texts], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array(keys[::2]), pa.array(keys[1::2])]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "uid", "size", "text_crc32", "group_key", "group_check"])


def place_groups(rows: DataFrame, n_shards: int) -> DataFrame:
    """``rows`` (group_key, group_check, size, ...) with the shard of their group."""
    spark = rows.sparkSession
    groups = materialize(rows.groupBy("group_key", "group_check").agg(F.sum("size").alias("size")), "shard-groups")
    limit = (groups.agg(F.sum("size")).first()[0] or 0) / BUNDLES
    large = F.col("size") > limit
    items = groups.groupBy(
        large.alias("large"), F.when(large, F.col("group_key")).otherwise(F.pmod("group_key", F.lit(BUNDLES))).alias("key"), F.when(large, F.col("group_check")).otherwise(F.lit(0)).alias("check")
    ).agg(F.sum("size").alias("size"))
    sums = sorted(items.collect(), key=lambda r: (-r["size"], r["key"], r["check"]))  # 2 * BUNDLES rows at most
    shards = difference_sizes([r["size"] for r in sums], n_shards)
    alone = [(r["key"], r["check"], s) for r, s in zip(sums, shards, strict=True) if r["large"]]
    bundles = [(r["key"], s) for r, s in zip(sums, shards, strict=True) if not r["large"]]
    alone = spark.createDataFrame(alone, "group_key long, group_check long, own_shard int")
    bundles = spark.createDataFrame(bundles, "bundle long, bundle_shard int")
    return (
        rows.withColumn("bundle", F.pmod("group_key", F.lit(BUNDLES)))
        .join(F.broadcast(alone), ["group_key", "group_check"], "left").join(F.broadcast(bundles), "bundle", "left")
        .withColumn("shard", F.coalesce("own_shard", "bundle_shard")).drop("bundle", "own_shard", "bundle_shard")
    )


def _shards(docs: DataFrame, n_shards: int, row: str | None = None) -> DataFrame:
    """:func:`shard_documents` with uid, the value of column ``row`` or a number of its own for every row."""
    uid = F.col(row) if row else F.monotonically_increasing_id()
    rows = materialize(arrow_map(docs.select(F.col("doc_id").cast("long"), uid.alias("uid"), "text"), _rows, ROWS), "shard-rows")
    placed = place_groups(rows, n_shards).select("doc_id", "uid", "size", "text_crc32", "shard", F.lit(1).alias("one"))
    slotted = running_offsets(placed, "shard", "uid", "one", "slot")
    return slotted.select("uid", "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``)."""
    return _shards(docs, n_shards).drop("uid")


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """Write ``docs`` with all its columns as Parquet folders ``shard=0`` ... below ``path``; ValueError if it has a column ``shard``."""
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("a column shard is there already")
    keyed, row = with_rows(docs, "shard-input")
    shards = _shards(keyed, n_shards, row).select(F.col("uid").alias(row), "shard")
    keyed.join(shards, row).drop(row).write.partitionBy("shard").parquet(path)


def op4_karmarkar_karp_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
