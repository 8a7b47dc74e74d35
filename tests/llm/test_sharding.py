import random
import zlib
from collections import Counter, defaultdict

from tabweft.llm import sharding


def test_differencing_beats_greedy_and_is_complete():
    rng = random.Random(11)
    sizes = [int(rng.lognormvariate(7, 1)) + 1 for _ in range(2000)]
    shards = sharding.difference_sizes(sizes, 24)
    sums = Counter()
    for size, shard in zip(sizes, shards, strict=True):
        sums[shard] += size
    assert len(sums) == 24 and max(sums.values()) - min(sums.values()) <= 5
    greedy = [0] * 24
    for size in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += size
    assert max(sums.values()) - min(sums.values()) <= max(greedy) - min(greedy)


def test_known_example_in_two_parts():
    sums = Counter()
    for size, shard in zip([8, 7, 6, 5, 4], sharding.difference_sizes([8, 7, 6, 5, 4], 2), strict=True):
        sums[shard] += size
    assert sorted(sums.values()) == [14, 16]  # differencing leaves 2 here


def plain_differencing(sizes, n_shards):
    """The method on lists, the largest spread found by looking at all."""
    left = [[0] * (n_shards - 1) + [x] for x in sizes]
    while len(left) > 1:
        left.sort(key=lambda p: max(p) - min(p))
        a, b = sorted(left.pop()), sorted(left.pop(), reverse=True)
        left.append([x + y for x, y in zip(a, b, strict=True)])
    return sorted(left[0])


def test_against_plain_differencing():
    rng = random.Random(14)
    for n_shards in (2, 3, 7):
        for _ in range(20):
            sizes = rng.sample(range(1, 10**9), rng.randint(1, 60))  # no ties of spreads but by chance
            sums = [0] * n_shards
            for size, shard in zip(sizes, sharding.difference_sizes(sizes, n_shards), strict=True):
                sums[shard] += size
            assert sorted(sums) == plain_differencing(sizes, n_shards)
            assert max(sums) - min(sums) <= max(sizes)  # the bound that the module states


def test_written_shards_keep_all_columns(spark, tmp_path):
    rows = [(1, "a", 7), (1, "a", 8), (1, "b", 9), (None, "a", 10), (2, None, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_crc32 int")
    sharding.write_shards(docs, f"{tmp_path}/out", 2)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.text_crc32 for r in got.collect()) == [7, 8, 9, 10, 11]
    assert len({r.shard for r in got.collect() if r.text == "a"}) == 1


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUNDLES", 100)
    rng = random.Random(12)
    texts = [None, "", "é" * 10, "z" * 30_000] + ["hot text"] * 300 + ["t" * rng.randint(1, 400) + str(i) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(3)
    got = sharding.shard_documents(docs, 5).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    of_text, slots, sums = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        of_text[raw].add(r.shard)
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums.values()) < 100
    assert sharding.shard_documents(docs.limit(0)).count() == 0
